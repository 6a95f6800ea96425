import random

import duckdb
import pytest

from tallyloom.llm import search

DOCS = "doc_id long, text string, rank string, score string, head string"


def tables(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["THE", "the", "é9", "ÉA", "x-y"]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([5, 45])]) for _ in range(rng.randrange(n)))
    docs = [(rng.choice([i, i, 5, None]), rng.choice([text(60), text(6), "the w1 w2", None, "", "..."]), "clash", "clash", "clash") for i in range(300)]
    docs += [(1000 + i, "the w1 w3 w3", "clash", "clash", "clash") for i in range(120)] + [(7, "w4 " * 30_000, "clash", "clash", "clash")]
    items = [(i, rng.choice([text(12), "the", "W1 the w3", "nowhere", None, ""]), "clash") for i in range(30)] + [(3, "w7 w8", "clash"), (None, "w2", "clash")]
    return docs, items


@pytest.mark.parametrize("seed,at_once", [(1, 500_000), (2, 20)])
def test_search_against_sql(spark, monkeypatch, seed, at_once):
    """Many small blocks, several groups of items, ties in all places."""
    rows, asked = tables(seed)
    docs, items = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(asked, "item_id long, text string, doc_id string")
    monkeypatch.setattr(search.build_index, "__defaults__", (1 << 10,))
    columns = ["item_id", "rank", "doc_id", "score"]
    got = search.search(docs, items, terms_at_once=at_once).select(columns).toPandas()
    documents, benchmark = docs.toPandas(), items.toPandas()
    documents["doc_id"], benchmark["item_id"] = documents["doc_id"].astype("Int64"), benchmark["item_id"].astype("Int64")
    want = duckdb.sql(search.SQL).df()[columns]
    key = lambda df: sorted((tuple(None if x != x or x is None else int(x) for x in r) for r in df.astype(object).where(df.notna(), None).values.tolist()), key=str)
    assert key(got) == key(want) and len(want) > 500


def test_bounds_hold_the_exact_impact():
    import numpy as np

    tf, m = np.repeat(np.array([1, 2, 3, 50, 10**6]), 4), np.tile(np.array([50, 51, 400, 10**9]), 5)
    exact = search.impact(tf, m)
    byte = -(-exact // search.STEP)
    assert byte.max() <= 255 and (byte * search.STEP >= exact).all() and ((byte - 1) * search.STEP + 1 <= exact).all()


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(docs, items).count() == 0
    assert search.search(spark.createDataFrame([(1, "a", "", "", "")], DOCS), items.where("false")).count() == 0
