"""Choices in turn: rounds against the rule applied row by row, on small crowded graphs and on one component of 100,000 rows."""

import random

import pandas as pd
import pytest

from tallyloom.operators import replay
from tallyloom.operators.components import components


def places_in_turn(edges):
    own, taken, out = {}, set(), {}
    for txn, group, kind in edges:
        own.setdefault(txn, set()).add((group, kind))
    for txn in sorted(own):
        free = own[txn] - taken
        if len(free) == 1:
            taken |= free
            out[txn] = next(iter(free))[0]
    return out


def kinds_in_turn(pairs):
    own, used, out = {}, set(), set()
    for g, o, kind, label in pairs:
        own.setdefault(g, []).append((o, kind, label))
    for g in sorted(own):
        picked = {}
        for o, kind, label in sorted(own[g]):
            if o not in used:
                picked.setdefault(kind, (o, label))
        if any(label != "gross" for _, label in picked.values()):
            used |= {o for o, _ in picked.values()}
            out |= {(g, o, label) for o, label in picked.values()}
    return out


def graph(seed, rows, groups, most):
    rng, out = random.Random(seed), set()
    for i in range(rows):
        kind = rng.choice(["bank"] * 9 + ["ledger"])
        for _ in range(rng.randrange(1, most + 1)):
            out.add((f"r{i:06d}", f"g{rng.randrange(groups):06d}", kind))
    return sorted(out)


@pytest.mark.parametrize("seed,small", [(1, 0), (2, 0), (3, 60), (4, 20_000)])
def test_sole_places(spark, seed, small):
    edges = graph(seed, 150, 60, 3)
    df = spark.createDataFrame(edges, "txn_id string, group_id string, source_kind string")
    assert {r.txn_id: r.group_id for r in replay.sole_places(df, small).collect()} == places_in_turn(edges)
    assert replay.sole_places(df.where("false"), small).count() == 0


def test_sole_places_of_one_large_component(spark):
    edges = graph(9, 100_000, 60_000, 3)
    pdf = pd.DataFrame(edges, columns=["txn_id", "group_id", "source_kind"])
    df = spark.createDataFrame(pdf)
    sizes = components(df.selectExpr("'r' || txn_id AS u", "'g' || group_id || source_kind AS v")).groupBy("component").count()
    assert sizes.agg({"count": "max"}).first()[0] > 100_000
    assert {r.txn_id: r.group_id for r in replay.sole_places(df, 20_000).collect()} == places_in_turn(edges)


@pytest.mark.parametrize("bounded", [0, 40, 1000])
def test_components_by_rounds_and_by_one_task(spark, bounded):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(90)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    got = components(spark.createDataFrame(edges, "u string, v string"), bounded=bounded).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "u string, v string"), bounded=bounded).count() == 0


def test_chain_in_which_everyone_waits(spark):
    edges = [(f"r{i:02d}", f"g{j:02d}", "bank") for i in range(12) for j in (i, i + 1)]
    df = spark.createDataFrame(edges, "txn_id string, group_id string, source_kind string")
    assert {r.txn_id: r.group_id for r in replay.sole_places(df, 0).collect()} == places_in_turn(edges)


@pytest.mark.parametrize("seed,small", [(1, 0), (2, 0), (3, 50), (4, 20_000)])
def test_first_of_kinds(spark, seed, small):
    rng = random.Random(seed)
    pairs = {(f"g{rng.randrange(40):02d}", f"o{rng.randrange(60):02d}"): rng.choice(["gross", "gross", "gross_minus_fee", "gross_minus_fee_plus_tax"]) for _ in range(160)}
    pairs = [(g, o, "bank" if int(o[1:]) % 3 else "ledger", label) for (g, o), label in pairs.items()]
    df = spark.createDataFrame(pairs, "g string, o string, source_kind string, label string")
    assert {tuple(r) for r in replay.first_of_kinds(df, small).collect()} == kinds_in_turn(pairs)
    assert replay.first_of_kinds(df.where("false"), small).count() == 0
