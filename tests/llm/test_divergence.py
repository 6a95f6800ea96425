import random

import duckdb
import pytest

from tallyloom.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, team string, term string"


def fixture(seed):
    rng, rows = random.Random(seed), []
    for i in range(260):
        words = [rng.choice(["Éa", "the", "THE", "of9of", "über", "x-y", "zz"]) + rng.choice(["", "a", "b"]) for _ in range(rng.randrange(24))]
        lang = rng.choice(["en", "en", "en", "de", None, "f/r"])
        rows.append((rng.choice([i, 7, None]), rng.choice([" ".join(words), " ".join(words), "", None]), lang, rng.choice(["hot", "hot", "", None, "1/a", "b", "c", "d", "é"]), "clash", "clash"))
    rows += [(900 + i, None, "xx", f"s{i}", "clash", "clash") for i in range(3)]
    return rows


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("seed,team,shard", [(1, 8, 65_536), (2, 2, 3), (3, 1, 4)])
def test_divergence_against_sql(spark, seed, team, shard):
    rows = fixture(seed)
    docs = spark.createDataFrame(rows, DOCS)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    got = divergence.divergence(docs, team=team, shard=shard).select(columns).collect()
    documents = docs.toPandas()  # noqa: F841
    want = duckdb.sql(divergence.SQL).df()[columns].itertuples(index=False)
    want = key(want)
    assert key(got) == want and any(r[2] == "term" for r in want) and any(r[0] == "xx" and r[4] == 0 for r in want)


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_every_two_teams_meet_once(spark):
    """Pairs of packets in all rounds, with more rounds than one job takes."""
    packets = [("l", 0, t, 1, 1, [f"s{t}"], [5 + t], bytes(divergence.packed(*(divergence.smallest(divergence.np.array(x)) for x in ([1], [0], [5 + t]))))) for t in range(7)]
    got = divergence.rivals(spark.createDataFrame(packets, divergence.PACKET), at_once=2)
    assert sorted((r.source, r.item) for r in got.collect()) == sorted((f"s{a}", f"s{b}") for a in range(7) for b in range(7) if a != b)
    one = divergence.shares(divergence.np.array([0, 3, 10**13]), 2 * 10**13, 4)
    assert one.tolist() == [1 + 10**9 * (c + 5) // (2 * 10**13 + 20) for c in (0, 3, 10**13)]
