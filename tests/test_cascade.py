"""The whole cascade against the rule applied row by row in plain Python, on the derived records and on crowded random batches."""

import datetime
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tallyloom import queries
from tallyloom.functions import scalars as S
from tallyloom.operators import cascade as C
from tallyloom.operators import match as M
from tallyloom.plans.corpus import match_view

from .test_reconciliation import DATA, ROW, crowd, most_rows, records

RANK = {"gateway": 0, "bank": 1, "ledger": 2}


def crowded(batch, n, seed):
    """Rows whose few references, amounts and days meet in many ways, some of them empty."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["gateway", "bank", "ledger"])
        paise = rng.choice([1000, 976, 978, 980, 1001, -1000, -976, 5000])
        fee = rng.choice([20, None, 20]) if kind == "gateway" else None
        tax = None if fee is None else rng.choice([4, 4, None])
        day = rng.choice([None, *range(1, 12)])
        ref = rng.choice(["", None, "QX81", "X81", "ABCD81", "ABCD77", "MNO77", f"U{seed}{i}", "KK-MNO77", "RR QX81"])
        rows.append((f"{batch}{i:03d}", batch, kind, ref, paise, fee, tax, None, day and datetime.date(2024, 1, day), rng.choice(["w", "", None]), rng.choice(["set1", None, None, None]) if rng.random() < 0.2 else None))
    return rows


def near(a, b, most):
    return a["txn_date"] and b["txn_date"] and abs((a["txn_date"] - b["txn_date"]).days) <= most


def linked(a, b):
    x, y = a["full"], b["full"]
    if not a["external_ref"] or not b["external_ref"] or abs(a["amount_paise"] - b["amount_paise"]) > 1 or not near(a, b, 3):
        return False
    short, long = sorted((x, y), key=len)
    return x == y or x[-8:] == y[-8:] or 3 <= len(short) <= 4 and long.endswith(short)


def label(amount, g):
    """The tightest form of a gateway row's amount that explains the other amount."""
    gross, fee, tax = g["amount_paise"], g["fee_paise"], g["tax_paise"]
    forms = [("gross", gross, 0)]
    if fee is not None:
        forms.append(("fee", gross - fee, 0))
        if tax is not None:
            forms += [("both", gross - fee - tax, 0), ("rounded", gross - fee - tax, 2)]
    hits = [(abs(amount - want), i, name) for i, (name, want, slack) in enumerate(forms) if abs(amount - want) <= slack]
    return min(hits)[2] if hits else None


def corroborated(a, b):
    if near(a, b, 3):
        return True
    return a["full"] is not None and b["full"] is not None and (a["full"] == b["full"] or a["full"][-8:] == b["full"][-8:])


def loose(rows):
    differs = lambda f: len({f(r) for r in rows}) > 1
    return 95 - 5 * sum(map(differs, (lambda r: r["full"] if r["external_ref"] else None, lambda r: r["amount_paise"], lambda r: r["txn_date"])))


def cascade(rows):
    """{txn_id: (group_id, tier, strategy, confidence)} of one batch."""
    rows = sorted(rows, key=lambda r: r["txn_id"])
    groups = {}  # group_id: [members, tier, strategy, confidence]

    def left():
        seen = {r["txn_id"] for g in groups.values() for r in g[0]}
        return [r for r in rows if r["txn_id"] not in seen]

    kinds = lambda members: {r["source_kind"] for r in members}
    buckets = defaultdict(list)
    for r in rows:
        if r["external_ref"]:
            buckets[r["external_ref"], r["amount_paise"], r["txn_date"]].append(r)
    for own in buckets.values():
        if len(kinds(own)) > 1:
            groups["t1:" + own[0]["txn_id"]] = [own, 1, C.EXACT, 100]

    rest, root = left(), {}
    for r in rest:
        root[r["txn_id"]] = r["txn_id"]
    for _ in rest:
        for a in rest:
            for b in rest:
                if a["source_kind"] != b["source_kind"] and linked(a, b):
                    root[a["txn_id"]] = root[b["txn_id"]] = min(root[a["txn_id"]], root[b["txn_id"]])
        if all(root[a["txn_id"]] == root[b["txn_id"]] for a in rest for b in rest if a["source_kind"] != b["source_kind"] and linked(a, b)):
            break
    for r in rest:
        own = [x for x in rest if root[x["txn_id"]] == r["txn_id"]]
        if len(own) > 1:
            groups["t2:" + r["txn_id"]] = [own, 2, C.REFERENCE, loose(own)]

    touched = set()
    for r in left():
        fit = [g for g, (own, *_) in groups.items() if r["source_kind"] not in kinds(own) and any(linked(r, m) for m in own)]
        if len(fit) == 1:
            groups[fit[0]][0].append(r)
            touched.add(fit[0])
    for g in touched:
        groups[g][3] = loose(groups[g][0])

    before, used = list(groups), set()
    rest = left()
    for g in (r for r in rest if r["source_kind"] == "gateway"):
        own, names = [g], []
        for r in rest:
            if r["txn_id"] not in used and r["source_kind"] not in kinds(own) and label(r["amount_paise"], g) and corroborated(g, r):
                own.append(r)
                names.append(label(r["amount_paise"], g))
        telling = [n for n in names if n != "gross"]
        if telling:
            used |= {r["txn_id"] for r in own}
            groups["t3:" + g["txn_id"]] = [own, 3, C.FEE, 85 if telling[0] == "rounded" else 90]
    for r in left():
        fit = []
        for g in before:
            first = next((m for m in sorted(groups[g][0], key=lambda m: m["txn_id"]) if m["source_kind"] == "gateway"), None)
            if first and r["source_kind"] not in kinds(groups[g][0]) and label(r["amount_paise"], first) not in (None, "gross") and corroborated(first, r):
                fit.append((g, label(r["amount_paise"], first)))
        if len(fit) == 1:
            groups[fit[0][0]][0].append(r)
            groups[fit[0][0]][1:] = [3, C.FEE, 85 if fit[0][1] == "rounded" else 90]
    rest, gone = left(), set()
    key = lambda r: r["counterparty"] or "/" + "".join(c for c in (r["external_ref"] or "").upper() if c.isalnum())[-8:]
    for back in (r for r in rest if r["amount_paise"] < 0 and r["txn_date"]):
        fit = [r for r in rest if r["txn_id"] not in gone and r["amount_paise"] == -back["amount_paise"] and r["txn_date"] and key(r) == key(back) and 0 <= (back["txn_date"] - r["txn_date"]).days <= 30]
        if fit:
            best = min(fit, key=lambda r: (-r["txn_date"].toordinal(), r["txn_id"]))
            gone.add(best["txn_id"])
            groups["t3:" + best["txn_id"]] = [[best, back], 3, C.FEE, 90]

    head = {g: min(own, key=lambda r: (RANK[r["source_kind"]], r["txn_id"])) for g, (own, *_) in groups.items()}
    moves = {}
    for g, (own, *_) in groups.items():
        if all(r["amount_paise"] < 0 for r in own):
            ref, fit = head[g]["full"], []
            for o, (others, *_) in groups.items():
                if all(r["amount_paise"] > 0 for r in others):
                    x = head[o]
                    days = (head[g]["txn_date"] - x["txn_date"]).days if head[g]["txn_date"] and x["txn_date"] else 0
                    if x["full"] and len(x["full"]) >= 3 and ref and x["full"] in ref and -head[g]["amount_paise"] <= x["amount_paise"] and 0 <= days <= 30:
                        fit.append(o)
            if len(fit) == 1:
                moves[g] = fit[0]
    for g, o in moves.items():
        groups[o][0] += groups.pop(g)[0]
        groups[o][1:3] = [3, C.REFUND]

    def settle(claims, confidence):
        """claims {bank: payments}: each payment's whole group goes along, rows wanted twice to the least bank."""
        place = {r["txn_id"]: g for g, (own, *_) in groups.items() for r in own}
        wanted = {}
        for bank in sorted(claims, reverse=True):
            for p in claims[bank]:
                for r in groups[place[p["txn_id"]]][0] if p["txn_id"] in place else [p]:
                    wanted[r["txn_id"]] = (bank, r)
        for own, *_ in groups.values():
            own[:] = [r for r in own if r["txn_id"] not in wanted]
        for bank in {b for b, _ in wanted.values()}:
            groups["t4:" + bank] = [[r for b, r in wanted.values() if b == bank] + [r for r in rows if r["txn_id"] == bank], 4, C.SETTLEMENT, confidence]

    by_id = {}
    for bank in (r for r in left() if r["source_kind"] == "bank" and r["settlement_id"]):
        paid = [r for r in rows if r["source_kind"] == "gateway" and r["settlement_id"] == bank["settlement_id"]]
        if paid:
            by_id[bank["txn_id"]] = paid
    settle(by_id, 90)
    tied = {r["txn_id"] for own, *_ in groups.values() if "bank" in kinds(own) for r in own}
    free = {r["txn_id"]: r for r in rows if r["source_kind"] == "gateway" and r["fee_paise"] is not None and r["txn_date"] and r["txn_id"] not in tied}
    net = lambda r: r["net_paise"] if r["net_paise"] is not None else r["amount_paise"] - r["fee_paise"] - (r["tax_paise"] or 0)
    searched = {}
    for bank in sorted((r for r in left() if r["source_kind"] == "bank" and r["txn_date"]), key=lambda r: (-r["amount_paise"], r["txn_id"])):
        pool = [r for r in free.values() if 0 <= (bank["txn_date"] - r["txn_date"]).days <= 10 and net(r) <= bank["amount_paise"]]
        pool = sorted(pool, key=lambda r: (-net(r), r["txn_id"]))[:60]
        found = M.subset_of(bank["amount_paise"], [net(r) for r in pool]) if len(pool) >= 5 else None
        if found and len(found) >= 5:
            searched[bank["txn_id"]] = [pool[i] for i in found]
            for i in found:
                free.pop(pool[i]["txn_id"])
    settle(searched, 75)
    return {r["txn_id"]: (g, *more) for g, (own, *more) in groups.items() for r in own}


def test_cascade_against_rule(spark):
    nets = [101, 203, 407, 815, 1631]
    credit = [(f"s{i}", "s", "gateway", f"S{i}x", n, 0, 0, n, datetime.date(2024, 1, 5), None, None) for i, n in enumerate(nets)]
    credit += [(f"sl{i}", "s", "ledger", f"S{i}x", n, None, None, None, datetime.date(2024, 1, 5), None, None) for i, n in enumerate(nets)]
    credit += [("sk", "s", "bank", "ST", sum(nets), None, None, None, datetime.date(2024, 1, 6), None, None), ("sz", "s", "bank", "SZ", 77, None, None, None, datetime.date(2024, 1, 6), None, None)]
    made = spark.createDataFrame([*(r for i in range(6) for r in crowded(f"z{i}", 20 + 12 * i, i)), *credit], ROW)
    t = match_view(queries.txns(spark, DATA)).unionByName(made)
    got = {r.txn_id: (r.group_id, r.tier, r.strategy, r.confidence_pct) for r in C.run(t).collect()}
    batches = defaultdict(list)
    for r in t.withColumn("full", S.full_ref(F.col("external_ref"))).collect():
        batches[r.batch_id].append(r.asDict())
    want = {k: v for own in batches.values() for k, v in cascade(own).items()}
    assert {x[1:3] for x in want.values()} == {(1, C.EXACT), (2, C.REFERENCE), (3, C.FEE), (3, C.REFUND), (4, C.SETTLEMENT)}
    wrong = {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)}
    assert not wrong, (len(wrong), sorted(wrong.items())[:10])


def test_unsettled_reasons_and_empty_tables(spark):
    rows = [(f"p{i}", "gateway", f"P{i}", 10 + i, 0, 0, 5) for i in range(6)]
    t = records(spark, [*rows, ("k1", "bank", "X", 12345, None, None, 6), ("k2", "bank", "Y", 60_000_000, None, None, 6), ("k3", "bank", "Z", 50, None, None, 3)])
    members = C.run(t)
    assert members.count() == 0
    assert sorted((r.bank, r.payments, r.reason) for r in C.unsettled(t, members).collect()) == [("k1", 6, "no_subset_found"), ("k2", 6, "over_cap"), ("k3", 0, "no_payments")]
    none = records(spark, [])
    assert C.run(none).count() == 0 and [r.member_rows for r in C.report(none, C.run(none)).collect()] == [0]


def test_reasons_without_pairs(spark):
    """Payments of a window are counted, not listed."""
    t = crowd(spark)
    rows = C.unsettled(t, spark.createDataFrame([], "txn_id string, group_id string"), top=300)
    got = {r.bank: (r.payments, r.reason) for r in rows.collect()}
    assert got["k000"] == (2, "no_subset_found") and got["k399"] == (400, "some_left_out") and most_rows(rows) < 10 * 800


def test_members_are_written_once(spark, monkeypatch):
    """A tier writes the rows that it adds; all members are written again only where groups change or move."""
    n, real = [], C.written
    monkeypatch.setattr(C, "written", lambda df, what: n.append(df.count() if what == "members" else 0) or real(df, what))
    t = match_view(queries.txns(spark, DATA))
    C.run(t.where("substr(batch_id, 1, 4) = '1996'"))
    assert sum(x > n[0] for x in n) <= 5
