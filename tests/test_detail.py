"""Details, funnels, shown forms and made records."""

import datetime
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom import detail_queries
from tallyloom.functions import display as D
from tallyloom.operators import cascade, detail
from tallyloom.operators import match as M
from tallyloom.plans import scenarios as C
from tallyloom.plans.corpus import match_view
from tallyloom.streaming.activity import Pace, activity

from .test_reconciliation import DATA


@pytest.mark.parametrize("name", sorted(detail_queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    found = con.execute(detail_queries.ORACLES[name])
    names, got = [c[0] for c in found.description], detail_queries.QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(got.columns)
    want = sorted(map(repr, found.fetchall()))
    assert want and sorted(repr(tuple(r)) for r in got.select(*names).collect()) == want


def shown(spark, make, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    return [r[0] for r in rows.select(make(F.col("v"))).collect()]


def test_shown(spark):
    assert shown(spark, D.time_spent, None, 0.0, 59.94, 60.0, 119.7) == ["—", "0.0s", "59.9s", "1m 0s", "1m 60s"]
    assert shown(spark, D.ratio_text, None, 0.9748, 0.0) == ["—", "97.48%", "0.00%"]
    assert shown(spark, D.percent_text, None, 90.91) == ["—", "90.91%"]
    assert shown(spark, lambda v: D.count_text(v.cast("long")), None, -1234567.0, 999.0, 1000.0) == ["—", "-12,34,567", "999", "1,000"]
    now = datetime.datetime(2024, 1, 2)
    ago = lambda v: D.time_apart(F.timestamp_seconds(F.unix_timestamp(F.lit(now)) + v.cast("long")), F.lit(now))
    assert shown(spark, ago, None, 0.0, -44.0, -45.0, 3599.0, 3600.0, 86399.0, -86400.0) == ["—", "0s ago", "44s ago", "1m ago", "in 60m", "in 1h", "in 24h", "1d ago"]
    text = lambda v: D.padded(D.shortened(F.format_string("%.0f", v), "id"), 3)
    assert shown(spark, text, 1234567890.0, 1.0) == ["12345678", "1  "]


def test_details_fail_on_a_leak(spark):
    row = ("a", "bank", "r", 1, None, None, None, None, None, "synthetic:x", "c", {"category": "x", "k": "v"})
    schema = ", ".join(f"{n} {'map<string,string>' if n == 'raw' else 'long' if n.endswith('paise') else 'date' if n.endswith('date') else 'string'}" for n in detail.DETAIL)
    good, bad = (spark.createDataFrame([row[:2] + (ref,) + row[3:]], schema) for ref in ("r", "synthetic:r"))
    found = detail.record_details(good).first()
    assert found.description == "" and found.raw == {"k": "v"}
    with pytest.raises(Exception, match="(?i)answer key|leak|mark"):
        detail.record_details(bad).collect()


def test_funnel_of_four_tiers(spark):
    t = spark.createDataFrame([(f"r{i}", "b") for i in range(9)], "txn_id string, batch_id string")
    rows = [("b", "g1", 1, "exact", "r0", 5), ("b", "g1", 1, "exact", "r1", 5), ("b", "g2", 3, "fee", "r2", 9), ("b", "g2", 3, "fee", "r3", 7), ("b", "g3", 3, "refund", "r4", 1), ("b", "g4", 4, "by id", "r5", 2)]
    members = spark.createDataFrame(rows, "batch_id string, group_id string, tier int, strategy string, txn_id string, amount_paise long")
    queue = spark.createDataFrame([("b", -4), ("b", 2)], "batch_id string, variance_paise long")
    got = [tuple(r)[1:] for r in detail.batch_funnel(t, members, queue).orderBy("place").collect()]
    assert got == [(0, "Records ingested", None, 9, "gateway + bank + ledger", 0), (1, "Tier 1", 1, 2, "exact", 0), (3, "Tier 3", 2, 3, "refund", 2), (4, "Tier 4", 1, 1, "by id", 0), (99, "Variance queue", 2, 3, "unmatched records + unbalanced groups", 6)]
    assert detail.batch_funnel(t.limit(0), members.limit(0), queue.limit(0)).count() == 0


def events(spark, n):
    return spark.range(n).select(F.col("id").alias("event_id"), F.when(F.col("id") < n // 3, "a").otherwise("b").alias("batch_id"), F.lit(datetime.date(2024, 1, 1)).alias("first_day"))


def test_made_records(spark):
    mix = C.Mix.of({"seed": "5", "most_payments": "7"})
    rows = C.generated(events(spark, 3000), mix).cache()
    by = {}
    for r in rows.collect():
        by.setdefault(r.scenario, {}).setdefault(r.truth_group or r.txn_id, []).append(r)
    assert rows.select("txn_id").distinct().count() == rows.count()
    assert len(by["fee_tax_split"]) == round(1000 * 0.13) + round(2000 * 0.13)
    for g in by["fee_tax_split"].values():
        own = {r.source_kind: r for r in g}
        assert own["bank"].amount_paise == own["gateway"].net_paise == own["gateway"].amount_paise - own["gateway"].fee_paise - own["gateway"].tax_paise
        assert own["gateway"].amount_paise == own["ledger"].amount_paise and len(g) == 3
    explicit = 0
    for g in by["many_to_one"].values():
        pay, credit = [r for r in g if r.source_kind == "gateway"], [r for r in g if r.source_kind == "bank"]
        assert len(credit) == 1 and 5 <= len(pay) <= 11 and len(g) == 2 * len(pay) + 1
        assert credit[0].amount_paise == sum(r.net_paise for r in pay) and credit[0].txn_date == max(r.txn_date for r in pay) + datetime.timedelta(1)
        assert len({r.settlement_id for r in [*pay, *credit]}) == 1 and (max(r.txn_date for r in pay) - min(r.txn_date for r in pay)).days <= 2
        explicit += credit[0].settlement_id is not None
    assert 0.4 < explicit / len(by["many_to_one"]) < 0.95
    assert {len(g) for g in by["refund_chargeback"].values()} == {6} and all(sum(r.amount_paise < 0 for r in g) == 3 for g in by["refund_chargeback"].values())
    assert {len(g) for g in by["missing_one_source"].values()} == {2} and {len(g) for g in by["duplicate_one_source"].values()} == {4}
    assert all(len(g) == 1 and g[0].truth_group is None for g in by["genuine_noise"].values()) and len({g[0].source_kind for g in by["genuine_noise"].values()}) == 3
    assert {(max(r.txn_date for r in g) - min(r.txn_date for r in g)).days for g in by["value_date_drift"].values()} == {1, 2, 3}
    sizes = sorted(g[0].amount_paise for s in ("clean_3way", "genuine_noise") for g in by[s].values())
    logs = [math.log(x) for x in sizes]
    mean = sum(logs) / len(logs)
    assert abs(mean - math.log(5000)) < 0.15 and abs(math.sqrt(sum((x - mean) ** 2 for x in logs) / len(logs)) - 1.2) < 0.15 and sizes[0] >= 100
    assert C.verified(rows, events(spark, 3000), mix).count() == 18
    again = C.generated(events(spark, 3000).repartition(7), mix)
    assert again.exceptAll(rows).count() == 0
    with pytest.raises(Exception, match="answer key"):
        C.verified(rows.withColumn("truth_group", F.when(F.col("scenario") != "clean_3way", F.col("truth_group"))), events(spark, 3000), mix).collect()


def test_small_and_empty_batches(spark):
    for n in (0, 1, 4, 20):
        e = events(spark, n)
        assert C.generated(e).select("truth_group").count() >= n * (n > 0) and C.verified(C.generated(e), e).count() >= (n > 0)


def test_options():
    assert C.Mix.of({}).weights == C.WEIGHTS and C.Mix.of({"seed": "9", "explicit_share": "0.5"}).explicit_share == 0.5
    for bad in ({"weight.clean_3way": "0.5"}, {"weight.other": "0"}, {"sed": "1"}, {"weight.clean_3way": "-0.1", "weight.genuine_noise": "0.683"}, {"least_payments": "9", "most_payments": "3"}):
        with pytest.raises(ValueError):
            C.Mix.of(bad)


def test_tiers_find_what_was_made(spark):
    """Every tier takes rows of the made records, and what it puts together mostly belongs together."""
    full = C.generated(events(spark, 400)).withColumn("counterparty", F.lit(None).cast("string")).cache()
    members = cascade.run(match_view(full).cache()).cache()
    assert {r.tier for r in members.select("tier").distinct().collect()} == {1, 2, 3, 4}
    scores = M.pair_scores(members, full.select("txn_id", "truth_group")).first()
    assert scores.precision > 0.97 and scores.recall > 0.6, scores
    key = {r.txn_id: (r.scenario, r.truth_group) for r in full.collect()}
    by = {}
    for r in members.collect():
        by.setdefault(r.group_id, []).append(r.txn_id)
    whole = {}
    for name, truth in set(key.values()):
        whole.setdefault(name, []).append({x for x, k in key.items() if k[1] == truth and truth})
    found = [set(x) for x in by.values()]
    share = lambda name: sum(g in found for g in whole[name]) / len(whole[name])
    assert share("clean_3way") > 0.9 and share("fee_tax_split") > 0.8 and share("value_date_drift") > 0.8
    assert not any(set(g) & {x for x, k in key.items() if k[0] == "genuine_noise"} for g in found if len(g) > 3)


def test_activity_as_a_stream(spark, tmp_path):
    """The same rows as from a table, in parts; shares, bounds and waits as the pace says."""
    ticks = spark.range(4000).select(F.col("id").alias("tick"), F.lit(datetime.datetime(2024, 1, 1)).alias("ts"))
    ticks.where("tick < 2500").write.parquet(f"{tmp_path}/in/a")
    ticks.where("tick >= 2500").write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    activity(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cursor").trigger(availableNow=True).start().awaitTermination()
    rows = activity(ticks)
    assert sorted(spark.read.parquet(f"{tmp_path}/out").select(*rows.columns).collect(), key=repr) == sorted(rows.collect(), key=repr)
    by = {}
    for r in rows.collect():
        by.setdefault(r.tick, []).append(r)
        assert 1200 <= (r.next_ts - r.ts).total_seconds() <= 5400
    busy = [g for g in by.values() if g[0].kind != "quiet"]
    assert len(by) == 4000 and abs(1 - len(busy) / 4000 - 0.35) < 0.03
    assert abs(sum(g[-1].kind == "refund" for g in busy) / len(busy) - 0.2) < 0.03
    for g in busy:
        pay = {r.place: r.amount_paise for r in g if r.kind == "payment"}
        assert 1 <= len(pay) <= 4 and all(30_000 <= x <= 500_000 and x % 100 == 0 for x in pay.values())
        assert all(-r.amount_paise in (pay[r.place], pay[r.place] // 3) for r in g if r.kind == "refund")
    assert activity(ticks.limit(0)).count() == 0 and activity(ticks, Pace(seed=2)).exceptAll(rows).count() > 0
