import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyloom import oracles, queries
from tallyloom.functions import scalars as S
from tallyloom.operators import match as M
from tallyloom.operators import replay, subset
from tallyloom.operators import tiers as T
from tallyloom.plans.corpus import guarded, match_view
from tallyloom.sources import files
from tallyloom.streaming import live

DATA = "/root/testdata/sf0.001"


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_money(spark):
    shown = ["₹1,23,456.78", "Rs. 5", "(1.00)", "10.00 DR", "10.00DR", "1.239", "-2.5", "", "abc", "INR .5", "12 CR", "1.2.3", "१२.५"]
    assert column(spark, shown, S.paise_of) == [12345678, 500, -100, -1000, 1000, 123, -250, None, None, 50, 1200, 123, 1250]
    assert column(spark, [0, 5, 12345, 123456789, -99900], S.rupees, "long") == ["0.00", "0.05", "123.45", "12,34,567.89", "999.00"]


def test_references(spark):
    assert column(spark, ["pay_00ab", "000", "PAYMENT", "txn-ref-9", "", None, "--"], S.full_ref)[:2] + column(spark, ["txn-ref-9", ""], S.full_ref) == ["AB", "000", "9", ""]
    assert column(spark, ["NEFT/ABC123/12 TRANSFER", "BY CR 12", "x_y zz", "TRF FROM RAZORPAY REF 0lEDmC DT 09/07", "BY TRANSFER-NEFT*rfnd_QVmvb0*RAZORPAY SOFTWARE"], S.extracted_ref) == ["ABC123", None, "x_y", "0lEDmC", "rfnd_QVmvb0"]


def test_dates(spark):
    days = column(spark, ["05/03/2024", "5-3-2024", "2024-03-05", "05/03/75", "05-03-24", "31/31/2024", ""], S.parsed_date)
    assert [str(x) if x else None for x in days] == ["2024-03-05"] * 3 + ["1975-03-05", "2024-03-05", None, None]


def test_numbers(spark):
    assert column(spark, ["Rs 1,234.50 on 2024-01-02, x9 and 7, or 8%"], S.numbers_in) == [["1234.50", "7", "8"]]


def test_subset_sum_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        nets = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 9))]
        target = rng.randrange(1, 200)
        sums = {}
        for k in range(1, len(nets) + 1):
            for c in itertools.combinations(range(len(nets)), k):
                sums.setdefault(sum(nets[i] for i in c), []).append(list(c))
        hits = [target] if target in sums else [s for s in range(target - 5, target + 6) if s in sums]
        want = sums[hits[0]][0] if len(hits) == 1 and len(sums[hits[0]]) == 1 else None
        assert subset.dense(target, nets, 5) == want and subset.sparse(target, nets, 5) == want and M.subset_of(target, nets) == want
    assert M.subset_of(10, [10, 0]) is None and M.subset_of(-1, [1]) is None


def test_subset_sum_of_any_size():
    """Large targets by halves, dense ones by bit sets; both where both can."""
    rng = random.Random(4)
    nets = sorted((rng.randrange(10**9, 4 * 10**9) for _ in range(60)), reverse=True)
    own = sorted(rng.sample(range(60), 5))
    assert subset.subset_of(sum(nets[i] for i in own), nets, cap=None) == own and subset.subset_of(10**10, nets) is None
    nets = [rng.randrange(900, 100_000) for _ in range(40)]
    for total in (sum(nets[:3]), 400_001, nets[5]):
        assert subset.dense(total, nets[:22], 5) == subset.sparse(total, nets[:22], 5)
    assert subset.dense(1_500_000, nets, 5) is None and subset.sparse(1_500_000, nets, 5) is None
    assert subset.dense(48_000_000, [n * 97 for n in nets] + [1], 0) is None


def settled_in_turn(rows, top):
    """The rule in plain Python: bank rows by falling amount, each among the largest free payments of 10 days."""
    free, out = {r["txn_id"]: r for r in rows if r["source_kind"] == "gateway"}, {}
    for k in sorted((r for r in rows if r["source_kind"] == "bank"), key=lambda r: (-r["amount_paise"], r["txn_id"])):
        pool = sorted((r for r in free.values() if 0 <= (k["txn_date"] - r["txn_date"]).days <= 10 and r["amount_paise"] <= k["amount_paise"]), key=lambda r: (-r["amount_paise"], r["txn_id"]))[:top]
        hits = [c for n in range(5, len(pool) + 1) for c in itertools.combinations(pool, n) if sum(r["amount_paise"] for r in c) == k["amount_paise"]]
        other = [c for n in range(1, 5) for c in itertools.combinations(pool, n) if sum(r["amount_paise"] for r in c) == k["amount_paise"]]
        near = [c for n in range(1, len(pool) + 1) for c in itertools.combinations(pool, n) if abs(sum(r["amount_paise"] for r in c) - k["amount_paise"]) <= 5]
        found = hits if hits or other else [c for c in near]
        if len(found) == 1 and not other and len(found[0]) >= 5:
            out[k["txn_id"]] = {r["txn_id"] for r in found[0]}
            for r in found[0]:
                free.pop(r["txn_id"])
    return out


@pytest.mark.parametrize("top", [60, 8])
def test_search_in_turn_against_rule(spark, top):
    """Windows overlap, so a larger row's taking decides what smaller ones find; top is passed through."""
    rng = random.Random(top)
    paid = [(f"p{i:02d}", "gateway", f"P{i}", rng.randrange(1000, 90_000), 0, 0, 1 + i // 2) for i in range(14)]
    banks = []
    for i in range(8):
        at = rng.randrange(0, 9)
        own = rng.sample(paid[at : at + 6], 5)
        banks.append((f"k{i}", "bank", f"K{i}", sum(r[3] for r in own) + rng.choice([0, 0, 3]), None, None, max(r[6] for r in own) + 1))
    t = records(spark, [*paid, *banks])
    got = {}
    for r in M.settled_rows(t, T.earlier_members(t), top=top).collect():
        got.setdefault(r.bank, set()).add(r.txn_id)
    assert got == settled_in_turn([r.asDict() for r in t.collect()], top) and (top < 60 or got)


ROW = "txn_id string, batch_id string, source_kind string, external_ref string, amount_paise long, fee_paise long, tax_paise long, net_paise long, txn_date date, counterparty string, settlement_id string"


def records(spark, rows, more=""):
    """Rows of (txn_id, source, ref, amount, fee, tax, day of January or None, ...) as records of one batch."""
    full = [(i, "b", kind, ref, paise, fee, tax, None, datetime.date(2024, 1, day) if day else None, None, None, *rest) for i, kind, ref, paise, fee, tax, day, *rest in rows]
    return spark.createDataFrame(full, ROW + more)


def test_fee_groups(spark):
    rows = [("g1", "gateway", "AAA1", 1000, 20, 4, 1), ("g2", "gateway", "AAA2", 1000, 20, 4, 2), ("g3", "gateway", "AAA3", 500, 10, 0, 1)]
    rows += [("k1", "bank", "X", 976, None, None, 2), ("k2", "bank", "X", 978, None, None, 3), ("l1", "ledger", "X", 1000, None, None, 1), ("l3", "ledger", "X", 500, None, None, 1), ("k9", "bank", "X", 976, None, None, 20)]
    got = sorted((r.group_id, r.txn_id, r.label) for r in T.fee_groups(records(spark, rows)).collect() if r.label)
    assert got == [("t3:g1", "k1", "gross_minus_fee_minus_tax"), ("t3:g1", "l1", "gross"), ("t3:g2", "k2", "gross_minus_fee_plus_tax")]
    assert T.fee_groups(records(spark, [])).count() == 0


def test_fee_attach(spark):
    members = records(spark, [("g1", "gateway", "AAA1", 1000, 20, 4, 1, "t1:a"), ("l1", "ledger", "AAA1", 1000, None, None, 1, "t1:a"), ("g2", "gateway", "BBB1", 700, 20, 4, 1, "t1:b"), ("k2", "bank", "BBB1", 700, None, None, 1, "t1:b")], ", group_id string")
    orphans = records(spark, [("k1", "bank", "Q", 976, None, None, 2), ("k3", "bank", "Q", 980, None, None, 2), ("k4", "bank", "Q", 676, None, None, 2), ("k5", "bank", "Q", 976, None, None, 25)])
    assert sorted(map(tuple, T.fee_attached(orphans, members).collect())) == [("k1", "t1:a")]


def test_refund_merges(spark):
    kinds = ("gateway", "bank")
    group = lambda g, ref, paise, day: [(f"{g}{k}", k, ref, paise, None, None, day, g) for k in kinds]
    rows = group("o1", "QVM123", 500, 1) + group("r1", "rfnd_QVM123", -500, 31) + group("r2", "rfnd_QVM123", -501, 5)
    rows += group("o3", "ZZTOP", 500, 2) + group("o4", "ZZTO", 500, 2) + group("r3", "rfnd_ZZTOP", -100, 3) + group("r5", "rfnd_QVM123", -10, None) + group("o6", "AB", 9, 1) + group("r6", "rfnd_AB", -9, 1)
    members = records(spark, rows, ", group_id string")
    assert sorted(map(tuple, T.refund_merges(members).collect())) == [("r1", "o1"), ("r5", "o1")]
    assert T.with_refunds(members).where("group_id = 'o1'").count() == 6


def test_settlements_by_search(spark):
    nets = {"p1": 101, "p2": 203, "p3": 407, "p4": 815, "p5": 1631, "q1": 3301, "q2": 6703, "q3": 13007, "q4": 27011, "q5": 54001}
    rows = [(i, "gateway", i, n, 0, 0, 5) for i, n in nets.items()]
    small, large = (sum(n for i, n in nets.items() if i[0] == c) for c in "pq")
    # k1 is no generator's id; k2 and k3 want the payments that the larger k1 takes or that a bank row has
    rows += [("k1", "bank", "X", large, None, None, 9), ("k2", "bank", "Y", large - 3, None, None, 9), ("k3", "bank", "Z", small, None, None, 9), ("k4", "bank", "V", small, None, None, 9), ("k9", "bank", "W", large, None, None, 20)]
    t = records(spark, rows)
    members = lambda *pairs: t.join(spark.createDataFrame(list(pairs), "txn_id string, group_id string"), "txn_id")
    got = lambda *pairs: sorted(map(tuple, M.settled_once(t, members(*pairs)).collect()))
    assert got(("k4", "g4")) == [("k1", 5, large, 0), ("k3", 5, small, 0)]
    assert got(("p1", "g1"), ("k4", "g1")) == [("k1", 5, large, 0)]


def test_chunks(spark):
    rows = [(n, i) for n in range(1, 45) for i in range(n)]
    got = {}
    for r in T.chunked(spark.createDataFrame(rows, "k int, i int"), ["k"], ["i"]).collect():
        got.setdefault(r.k, []).append((r.i, r.chunk))
    for n, own in got.items():
        sizes = [sum(c == k for _, c in own) for k in range(max(c for _, c in own) + 1)]
        assert sorted(own) == sorted(own, key=lambda x: (x[1], x[0])) and sum(sizes) == n
        assert n <= 10 and sizes == [n] or all(5 <= s <= 10 for s in sizes) and len(sizes) == -(-n // 10)


def test_chunks_of_one_large_key(spark):
    rows = [(None, i) for i in range(503)] + [(1, i) for i in range(3)]
    got = T.chunked(spark.createDataFrame(rows, "k int, i int"), ["k"], [F.desc("i")]).collect()
    assert sorted((r.i, r.chunk) for r in got if r.k is None) == [(i, 50 if i < 5 else (502 - i) // 10) for i in range(503)]
    assert sorted((r.i, r.chunk) for r in got if r.k == 1) == [(0, 0), (1, 0), (2, 0)]
    assert T.chunked(spark.createDataFrame([], "k int, i int"), ["k"], ["i"]).count() == 0


def test_redaction(spark):
    assert column(spark, ["synthetic:x", "a", None], S.redacted_description) == ["", "a", ""]
    assert column(spark, ["is Synthetic:ab_1 so"], S.scrubbed_claim) == ["is  so"]
    assert column(spark, [{"category": "x", "a": "1", "synthetic": "y"}, None], S.redacted_raw, "map<string,string>") == [{"a": "1"}, None]


def test_firewall(spark):
    with pytest.raises(ValueError):
        guarded(spark.createDataFrame([("x", True)], "truth_group string, is_noise boolean"))


def test_bank_csv_round_trip(spark, tmp_path):
    t = match_view(queries.txns(spark, DATA)).where("source_kind = 'bank' and length(external_ref) = 6 and external_ref rlike '[A-F]'").limit(50)
    files.write_bank_csv(t, f"{tmp_path}/bank")
    back = files.read_bank_csv(spark, f"{tmp_path}/bank")
    assert back.where("reason is not null").count() == 0
    want = t.select("external_ref", "amount_paise", "txn_date")
    got = back.select("external_ref", "amount_paise", "txn_date")
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0


def test_bank_csv_bad_rows(spark, tmp_path):
    (tmp_path / "b.csv").write_text('value_date,narration,debit,credit,balance\n01/02/2024,NEFT/AB12,,"1,000.00",1\nbroken\n01/02/2024,x,1,2,3\n99/99/2024,REFX,1.00,,3\n02/02/2024,ZZ9,5.00,,3\n')
    rows = sorted(files.read_bank_csv(spark, str(tmp_path)).collect(), key=lambda r: r.line)
    assert [(r.line, r.amount_paise, r.reason) for r in rows] == [(2, 100000, None), (3, None, "exactly one of debit and credit"), (4, -100, "exactly one of debit and credit"), (5, -100, "date"), (6, -500, None)]


def test_ledger_xlsx(spark, tmp_path):
    (tmp_path / "l.xlsx").write_bytes(files.ledger_workbook([("05-03-2024", "V1", "Sale & co", "1,234.50 DR"), ("06-03-2024", "V2", "x", "oops"), ("", "", "", "")]))
    rows = files.read_ledger_xlsx(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r.external_ref, r.amount_paise, r.reason) for r in rows] == [("V1", -123450, None), ("V2", None, "amount")]


def test_stream_takes_files_once(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    for i in range(2):
        events.where(f"event_id % 2 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):
            live.ingest(spark, f"{tmp_path}/in", events.schema, f"{tmp_path}/out", f"{tmp_path}/cursor").awaitTermination()
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == events.count()
    assert sorted(live.daily(back).collect()) == sorted(live.daily(events).collect())


def test_daily_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(DATA)
    q = live.daily_stream(stream).writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("daily").collect()) == sorted(live.daily(events).collect())


@pytest.mark.parametrize("name", ["t1_exact_groups", "t2_clusters", "fee_interpretations", "refund_pairs_asof", "settlement_by_id", "variance_queue", "pair_scores", "refund_group_merge", "settlement_absorption", "score_by_tier", "source_histogram", "confidence_histogram", "interpretation_counts", "open_by_batch", "most_open_batches", "review_chunks", "redaction"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    want = con.execute(oracles.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def most_rows(df):
    """The most rows that any step of df's plan gave out when it ran."""
    df.collect()
    plans, most = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            plans.append(plan.plan())
        metric = plan.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return most


def test_candidates_without_pairs(spark):
    """Bank rows and payments of one batch are not multiplied: a bank row has its candidates and no more."""
    rows = [(f"p{i:03d}", "gateway", f"P{i}", 1000 + i // 2, 0, 0, 1 + i % 9) for i in range(400)]
    rows += [(f"k{i:03d}", "bank", f"K{i}", 1000 + i, None, None, 10) for i in range(400)]
    t = records(spark, rows)
    found = M.rule_candidates(*M.open_settlements(t, spark.createDataFrame([], "txn_id string, group_id string")), top=3)
    assert found.count() == 400 * 3 - 1 and most_rows(found) < 10 * 800


@pytest.mark.parametrize("taken", [False, True])
def test_candidates_against_rule(spark, taken):
    """Ties, days, currencies, and payments that a larger row takes."""
    rng = random.Random(7)
    coin = lambda: rng.choice(["INR", "USD", "", None])
    paid = [(f"p{i:02d}", "gateway", f"P{i}", rng.randrange(10, 30), 0, 0, rng.randrange(1, 25), coin()) for i in range(60)]
    banks = [(f"k{i:02d}", "bank", f"K{i}", rng.randrange(5, 40), None, None, rng.randrange(1, 28), coin()) for i in range(30)]
    t = records(spark, [*paid, *banks], ", currency string")
    of = {p[0]: rng.choice(banks) for p in paid if rng.random() < 0.4} if taken else {}
    gone = spark.createDataFrame([(p, k[0], k[3]) for p, k in of.items()], "txn_id string, by string, size long") if taken else None
    bank, pay = M.open_settlements(t, spark.createDataFrame([], "txn_id string, group_id string"))
    got = sorted((r.bank, r.place, r.txn_id, r.net) for r in M.rule_candidates(bank, pay, gone, top=4).collect())
    rank = lambda k: (-k[3], k[0])
    fits = lambda k, p: p[3] <= k[3] and 0 <= k[6] - p[6] <= 10 and (not k[7] or not p[7] or k[7] == p[7]) and not (p[0] in of and rank(of[p[0]]) < rank(k))
    want = [(k[0], i, p[0], p[3]) for k in banks for i, p in enumerate(sorted((p for p in paid if fits(k, p)), key=lambda p: (-p[3], p[0]))[:4], 1)]
    assert got == sorted(want) and len(got) > 50
    if not taken:
        seen = {r.bank: r.seen for r in M.in_window(bank, pay).select("bank", "seen").collect()}
        assert seen == {k[0]: sum(fits(k, p) for p in paid) for k in banks}


def crowd(spark):
    rows = [(f"p{i:03d}", "gateway", f"P{i}", 1000 + i // 2, 0, 0, 1 + i % 9) for i in range(400)]
    rows += [(f"k{i:03d}", "bank", f"K{i}", 1000 + i, None, None, 10) for i in range(400)]
    return records(spark, rows)


def test_search_without_pairs(spark, monkeypatch):
    """No table of the settlement search is made by way of all pairs of bank rows and payments."""
    most, real = [], M.written
    monkeypatch.setattr(M, "written", lambda df, what: most.append(most_rows(df)) or real(df, what))
    none = spark.createDataFrame([], "txn_id string, group_id string")
    assert M.settled_rows(crowd(spark), none, top=6).count() == 0 and len(most) > 3 and max(most) < 10 * 800
