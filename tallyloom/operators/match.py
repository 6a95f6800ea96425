"""The matching tiers as DataFrame functions. A group's id is the least txn_id of its members with its tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.corpus import guarded
from .components import components
from .replay import SMALL, sole_places
from .shared import written
from .subset import CAP, TOP, subset_of


def source_rank():
    return F.when(F.col("source_kind") == "gateway", 0).when(F.col("source_kind") == "bank", 1).otherwise(2)


def with_group(df: DataFrame, keys: list[str], tier: str) -> DataFrame:
    w = W.partitionBy(*keys)
    return df.withColumn("group_id", F.concat(F.lit(f"{tier}:"), F.min("txn_id").over(w)))


def exact_members(t: DataFrame) -> DataFrame:
    """Tier 1: rows whose batch, reference, amount and date more than one source has. Null dates are equal."""
    of_key = W.partitionBy("batch_id", "external_ref", "amount_paise", "txn_date")
    rows = guarded(t).where(F.coalesce("external_ref", F.lit("")) != "").where("batch_id is not null and amount_paise is not null")
    kinds = rows.withColumns({"__least": F.min("source_kind").over(of_key), "__most": F.max("source_kind").over(of_key), "group_id": F.concat(F.lit("t1:"), F.min("txn_id").over(of_key))})
    return kinds.where("__least <> __most").drop("__least", "__most")


def groups_of(members: DataFrame) -> DataFrame:
    """One row per group: counts, amount spread, and confidence less 0.05 for each of normalised reference, amount and date that differs (null is a value)."""
    members = members.withColumn("__ref", S.full_ref(F.nullif(F.col("external_ref"), F.lit(""))))
    differs = lambda c: (F.size(F.collect_set(F.struct(c))) > 1).cast("int")
    confidence = F.lit(95) - 5 * (differs("__ref") + differs("amount_paise") + differs("txn_date"))
    return members.groupBy("group_id").agg(F.count("*").alias("member_count"), F.count_distinct("source_kind").alias("n_sources"), (F.max("amount_paise") - F.min("amount_paise")).alias("variance_paise"), confidence.cast("bigint").alias("confidence_pct"))


def with_roles(members: DataFrame) -> DataFrame:
    w = W.partitionBy("group_id").orderBy(source_rank(), "txn_id")
    return members.withColumn("role", F.when(F.row_number().over(w) == 1, "primary").otherwise("counterpart"))


def unmatched(t: DataFrame, members: DataFrame) -> DataFrame:
    return t.join(members.select("txn_id"), "txn_id", "left_anti")


def named(rows: DataFrame) -> DataFrame:
    """Rows with a reference: null and empty ones never link."""
    return rows.where(F.coalesce("external_ref", F.lit("")) != "")


def candidate_pairs(left: DataFrame, right: DataFrame, ordered: bool = True) -> DataFrame:
    """Pairs (a, b) of different sources in one batch: linked references, at most 1 paisa and 3 days apart.

    One equi-join on the last three characters and the amount, spread over its three neighbours.
    """
    own = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in ("txn_id", "batch_id", "source_kind", "amount_paise", "txn_date")), S.full_ref(F.col("external_ref")).alias(f"{p}_ref"))
    a = own(named(left), "a").where("a_ref is not null").withColumn("near", F.explode(F.sequence(F.col("a_amount_paise") - 1, F.col("a_amount_paise") + 1)))
    b = own(named(right), "b").where("b_ref is not null")
    on = (F.col("near") == F.col("b_amount_paise")) & (F.right("a_ref", F.lit(3)) == F.right("b_ref", F.lit(3))) & (F.col("a_batch_id") == F.col("b_batch_id"))
    on = on & (F.col("a_source_kind") != F.col("b_source_kind")) & (F.abs(F.datediff("a_txn_date", "b_txn_date")) <= 3)
    on = on & S.refs_link(F.col("a_ref"), F.col("b_ref"))
    on = on & (F.col("a_txn_id") < F.col("b_txn_id")) if ordered else on
    return a.join(b, on).select(F.col("a_txn_id").alias("a"), F.col("b_txn_id").alias("b"))


def cluster_members(t: DataFrame) -> DataFrame:
    """Tier 2: connected components of candidate pairs among rows that tier 1 left."""
    found = components(candidate_pairs(t, t), "a", "b", bounded=SMALL).withColumnRenamed("node", "txn_id")
    return guarded(t).join(found, "txn_id").withColumn("group_id", F.concat(F.lit("t2:"), "component")).drop("component")


def attached(orphans: DataFrame, members: DataFrame) -> DataFrame:
    """Tier 2 attach: orphans that one existing group takes up (linked to any member, source absent)."""
    edges = written(candidate_pairs(orphans, members, ordered=False), "pairs")
    kinds = members.groupBy("group_id").agg(F.collect_set("source_kind").alias("kinds"))
    full = edges.join(members.select(F.col("txn_id").alias("b"), "group_id"), "b").join(kinds, "group_id")
    full = full.join(orphans.select(F.col("txn_id").alias("a"), "source_kind"), "a").where(~F.array_contains("kinds", F.col("source_kind")))
    return sole_places(full.select(F.col("a").alias("txn_id"), "source_kind", "group_id"))


def fee_pairs(gateway: DataFrame, others: DataFrame) -> DataFrame:
    """Tier 3: gateway rows and rows of other sources whose amount a fee or tax explains, with the label."""
    return fee_links(gateway, others).select("g", "o", "source_kind", (F.col("gross") - F.col("amount_paise")).alias("deducted"), "label")


def fee_links(gateway: DataFrame, others: DataFrame) -> DataFrame:
    """The pairs of fee_pairs with both rows' amounts and dates: g, o, source_kind, gross, fee_paise, tax, amount_paise, g_date, o_date, label.

    Corroborated by reference or by dates at most 3 days apart. The expected amounts are spread to join on equality.
    """
    g = gateway.where("source_kind = 'gateway' and fee_paise is not null").select("batch_id", F.col("txn_id").alias("g"), F.col("amount_paise").alias("gross"), "fee_paise", F.col("tax_paise").alias("tax"), F.col("txn_date").alias("g_date"), S.full_ref(F.col("external_ref")).alias("g_ref"))
    both = F.col("gross") - F.col("fee_paise") - F.col("tax")
    expected = F.array_distinct(F.array(F.col("gross"), F.col("gross") - F.col("fee_paise"), *(both + i for i in range(-2, 3))))
    o = others.where("source_kind <> 'gateway'").select("batch_id", F.col("txn_id").alias("o"), "source_kind", "amount_paise", F.col("txn_date").alias("o_date"), S.full_ref(F.col("external_ref")).alias("o_ref"))
    pairs = g.withColumn("amount_paise", F.explode(expected)).join(o, ["batch_id", "amount_paise"])
    near = (F.abs(F.datediff("g_date", "o_date")) <= 3) | (F.col("g_ref") == F.col("o_ref")) | (S.last8(F.col("g_ref")) == S.last8(F.col("o_ref")))
    label = S.interpretations(F.col("amount_paise"), F.col("gross"), F.col("fee_paise"), F.col("tax"))
    return pairs.where(F.coalesce(near, F.lit(False))).select("g", "o", "source_kind", "gross", "fee_paise", "tax", "amount_paise", "g_date", "o_date", label.alias("label"))


def refund_pairs(t: DataFrame, days: int = 30) -> DataFrame:
    """Each negative row and the latest positive row of its key and amount in the days before, every positive row used once.

    The key is the counterparty, else the last 8 letters and digits of the reference. Negative
    rows choose in txn_id order, so each key and amount of a batch is replayed on its own.
    """
    key = F.coalesce(F.concat(F.lit("cp:"), F.nullif("counterparty", F.lit(""))), F.concat(F.lit("ref:"), S.last8(F.regexp_replace(F.upper(F.coalesce("external_ref", F.lit(""))), r"[^\p{L}\p{N}]", ""))))
    rows = guarded(t).where("amount_paise <> 0 and txn_date is not null").select("batch_id", key.alias("key"), F.abs("amount_paise").alias("size"), "txn_id", (F.col("amount_paise") < 0).alias("back"), F.datediff("txn_date", F.lit("1970-01-01").cast("date")).alias("day"))
    both = rows.groupBy("batch_id", "key", "size").agg(F.max("back").alias("a"), F.min("back").alias("b")).where("a and not b").drop("a", "b")
    dealt = rows.join(both, ["batch_id", "key", "size"])

    def claim(pdf):
        import pandas as pd

        free = sorted(zip(-pdf["day"][~pdf["back"]], pdf["txn_id"][~pdf["back"]]))  # the latest first, then the least txn_id
        out = []
        for refund, day in sorted(zip(pdf["txn_id"][pdf["back"]], pdf["day"][pdf["back"]])):
            at = next((i for i, (d, _) in enumerate(free) if 0 <= day + d <= days), None)
            if at is not None:
                d, original = free.pop(at)
                out.append((refund, original, int(day + d)))
        return pd.DataFrame(out, columns=["refund", "original", "days"])

    return dealt.groupBy("batch_id", "key", "size").applyInPandas(claim, "refund string, original string, days int")


def settlements_by_id(t: DataFrame) -> DataFrame:
    """Tier 4 by id: the bank credit of each settlement id, its payments' net sum and the residual."""
    net = F.coalesce("net_paise", F.when(F.col("fee_paise").isNotNull(), F.col("amount_paise") - F.col("fee_paise") - F.coalesce("tax_paise", F.lit(0))), "amount_paise")
    rows = guarded(t).where("settlement_id is not null").withColumn("net", net)
    bank = F.col("source_kind") == "bank"
    out = rows.groupBy("batch_id", "settlement_id").agg(F.sum(F.when(bank, F.col("amount_paise"))).alias("bank_paise"), F.sum(F.when(F.col("source_kind") == "gateway", F.col("net"))).alias("net_paise"), F.count_if(F.col("source_kind") == "gateway").alias("payments"))
    return out.where("bank_paise is not null and payments > 0").withColumn("residual_paise", F.col("bank_paise") - F.col("net_paise"))


def open_settlements(t: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tier 4 by search: bank rows that no earlier tier matched (bank, target), and gateway payments with fee known that no bank row has.

    members: txn_id and group_id of the earlier tiers. Settlements by id come first: they resolve
    open bank rows whose id a payment of the batch has, and take these payments and their groups.
    t may have a currency; null and empty ones are not declared.
    """
    currency = F.nullif(F.col("currency"), F.lit("")) if "currency" in t.columns else F.lit(None).cast("string")
    day = F.datediff("txn_date", F.lit("1970-01-01").cast("date"))
    own = members.select("txn_id", "group_id")
    by_id = settlement_ids(t, members)
    of_bank = t.where("source_kind = 'bank'").select("txn_id").join(own, "txn_id").select("group_id").distinct()
    tied = own.join(of_bank, "group_id", "left_semi").select("txn_id").unionByName(by_id)
    bank = unmatched(guarded(t).where("source_kind = 'bank' and txn_date is not null and amount_paise is not null"), members).join(by_id, "txn_id", "left_anti")
    bank = bank.select("batch_id", F.col("txn_id").alias("bank"), F.col("amount_paise").alias("target"), F.col("txn_date").alias("b_date"), currency.alias("b_currency"), F.explode(F.array(F.floor(day / 10), F.floor(day / 10) - 1)).alias("bin"))
    pay = guarded(t).where("source_kind = 'gateway' and fee_paise is not null and txn_date is not null").join(tied, "txn_id", "left_anti")
    net = F.coalesce("net_paise", F.col("amount_paise") - F.col("fee_paise") - F.coalesce("tax_paise", F.lit(0)))
    return bank, pay.select("batch_id", "txn_id", net.alias("net"), "txn_date", currency.alias("currency"), F.floor(day / 10).alias("bin"))


def in_window(bank: DataFrame, pay: DataFrame, taken: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """Bank rows (batch_id, bank, target, b_date, b_currency) with seen, how many payments of their window are no larger than they, and near, the `top` largest of these (net, txn_id), largest first.

    The window is the batch's payments of the 10 days before, not of another declared currency. It
    depends on batch, date and currency alone, so the payments of each such slot are put in order
    with its bank rows, and a bank row looks back over at most `top` payments: pairs are not listed.
    taken (txn_id, by, size): the largest bank row that takes a payment; it is in near only for that row and larger ones.
    """
    own = bank.where(F.col("bin") == F.floor(F.datediff("b_date", F.lit("1970-01-01").cast("date")) / 10))
    slots = bank.select("batch_id", "bin", "b_date", "b_currency").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    pay = pay.withColumns({"by": none("string"), "size": none("long")}) if taken is None else pay.join(taken, "txn_id", "left")
    dealt = slots.join(pay.where("net is not null"), ["batch_id", "bin"]).where("txn_date between date_sub(b_date, 10) and b_date and coalesce(currency = b_currency, true)")
    key = ["batch_id", "b_date", "b_currency"]
    rows = dealt.select(*key, F.col("net").alias("value"), "txn_id", "by", "size", none("string").alias("bank"))
    rows = rows.unionByName(own.select(*key, F.col("target").alias("value"), none("string").alias("txn_id"), none("string").alias("by"), none("long").alias("size"), "bank"))
    slot = W.partitionBy(*key)
    upto = slot.orderBy("value", F.col("txn_id").desc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    paid, free = F.col("bank").isNull(), F.col("bank").isNull() & F.col("by").isNull()
    placed = rows.withColumns({"seen": F.count_if(paid).over(upto), "spot": F.count_if(free).over(upto)})
    # as many free payments as are wanted, and those taken that lie between them
    back = F.collect_list(F.when(paid, F.struct((-F.col("value")).alias("less"), "txn_id", "by", "size"))).over(slot.orderBy("spot").rangeBetween(1 - top, 0))
    found = placed.withColumn("back", back).where("bank is not null").withColumnRenamed("value", "target")
    fits = lambda x: (-x.less <= F.col("target")) & ~F.coalesce((x["size"] > F.col("target")) | ((x["size"] == F.col("target")) & (x["by"] < F.col("bank"))), F.lit(False))
    near = F.transform(F.slice(F.sort_array(F.filter("back", fits)), 1, top), lambda x: F.struct((-x.less).alias("net"), x.txn_id.alias("txn_id")))
    return found.select("batch_id", "bank", "target", "b_date", "b_currency", "seen", near.alias("near"))


def settlement_ids(t: DataFrame, members: DataFrame) -> DataFrame:
    """txn_id of the rows that settlements by id take: the open bank rows, their payments, and all rows of the payments' groups."""
    own = members.select("txn_id", "group_id")
    bank = unmatched(guarded(t).where("source_kind = 'bank' and settlement_id is not null"), members).select("batch_id", "settlement_id", F.col("txn_id").alias("bank"))
    paid = t.where("source_kind = 'gateway' and settlement_id is not null").select("batch_id", "settlement_id", "txn_id")
    picked = bank.join(paid, ["batch_id", "settlement_id"])
    taken = picked.select("txn_id").join(own, "txn_id").select("group_id").distinct()
    return picked.select(F.explode(F.array("bank", "txn_id")).alias("txn_id")).unionByName(own.join(taken, "group_id", "left_semi").select("txn_id")).distinct()


def rule_candidates(bank: DataFrame, pay: DataFrame, taken: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """For each bank row the payments in its window, largest first, less those that larger rows take (in_window)."""
    rows = in_window(bank, pay, taken, top)
    return rows.select("batch_id", "bank", "target", F.posexplode("near").alias("at", "p")).select("batch_id", "bank", "target", "p.txn_id", "p.net", (F.col("at") + 1).alias("place"))


def hopeful(rows: DataFrame, least: int = 5, tolerance: int = 5, cap: int | None = CAP):
    """Whether a search of near can find anything: its sums allow for `least` payments, all amounts are positive, and the target is within cap."""
    sum_of = lambda c: F.aggregate(c, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x.net).cast("decimal(38,0)"))
    n = F.size("near")
    lowest = F.element_at("near", -1)["net"]
    can = (n >= least) & (F.when(n >= least, sum_of(F.slice("near", -least, least))) <= F.col("target") + tolerance) & (sum_of(F.col("near")) >= F.col("target") - tolerance) & F.when(n > 0, lowest > 0)
    can = can if cap is None else can & (F.col("target") <= cap)
    return F.coalesce(can, F.lit(False))


def searched(rows: DataFrame, least: int = 5, tolerance: int = 5, cap: int | None = CAP) -> DataFrame:
    """The payments (batch_id, bank, target, txn_id, net) of the one subset of at least `least` of near that makes up a bank row.

    rows: batch_id, bank, target, near. Those whose sums rule it out, or with an amount that isn't positive, go before any search.
    """

    def search(batches):
        for pdf in batches:
            own = [subset_of(int(t), [int(p["net"]) for p in near], tolerance, cap) for t, near in zip(pdf["target"], pdf["near"])]
            pdf["near"] = [[near[i] for i in found] if found and len(found) >= least else [] for found, near in zip(own, pdf["near"])]
            yield pdf

    rows = rows.where(hopeful(rows, least, tolerance, cap)).select("batch_id", "bank", "target", "near")
    kind = "batch_id string, bank string, target long, near array<struct<net: long, txn_id: string>>"
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # searches take long for their bytes, so tasks are not put together by size
    found = rows.repartition(tasks, "bank").mapInPandas(search, kind)
    return found.select("batch_id", "bank", "target", F.explode("near").alias("p")).select("batch_id", "bank", "target", "p.txn_id", "p.net")


def settled_once(t: DataFrame, members: DataFrame, top: int = TOP, cap: int | None = CAP) -> DataFrame:
    """Tier 4 by search, a row per settled bank row: its payments, their net sum and the residual."""
    rows = settled_rows(t, members, top, cap).groupBy("bank", "target").agg(F.count("*").alias("payments"), F.sum("net").alias("net_paise"))
    return rows.select("bank", "payments", "net_paise", (F.col("target") - F.col("net_paise")).alias("residual_paise"))


def settled_rows(t: DataFrame, members: DataFrame, top: int = TOP, cap: int | None = CAP) -> DataFrame:
    """Tier 4 by search (batch_id, bank, target, txn_id, net): the bank rows of a batch, largest first, each take a subset of the payments that are still free.

    All rows search at once, then those again to which larger rows now leave other payments than
    in the round before, until nothing changes. Then every row has searched among what
    the larger ones leave, which only one assignment fulfils; the rounds are as many as takings
    depend on each other. A round looks only at rows with a payment in their window whose taking changed.
    """
    bank, pay = (written(x, "settle") for x in open_settlements(t, members))
    sign = F.xxhash64("near").alias("sign")
    first = in_window(bank, pay, top=top)
    whole = F.aggregate("near", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x.net).cast("decimal(38,0)"))
    first = first.where((F.size("near") >= 5) & (whole >= F.col("target") - 5))  # fewer payments never add up to more
    first = first if cap is None else first.where(F.col("target") <= cap)
    first = written(first.select("batch_id", "bank", "target", sign, F.when(hopeful(first, cap=cap), F.col("near")).alias("near")), "settle")
    bank = written(bank.join(first.select("bank"), "bank", "left_semi"), "settle")
    signs = first.select("bank", "sign")
    now = written(searched(first, cap=cap), "settle")
    before = now.select("txn_id", F.col("bank").alias("by"), F.col("target").alias("size")).limit(0)
    while True:
        best = F.min(F.struct((-F.col("target")).alias("less"), "bank")).alias("b")
        taken = written(now.groupBy("txn_id").agg(best).select("txn_id", F.col("b.bank").alias("by"), (-F.col("b.less")).alias("size")), "settle")
        both = taken.join(before.select("txn_id", F.col("by").alias("by0"), F.col("size").alias("size0")), "txn_id", "full").where(~(F.col("by").eqNullSafe(F.col("by0")) & F.col("size").eqNullSafe(F.col("size0"))))
        other = written(both.join(pay, "txn_id"), "settle")
        if not other.limit(1).count():
            return now
        larger = lambda size, by: F.coalesce((F.col(size) > F.col("target")) | ((F.col(size) == F.col("target")) & (F.col(by) < F.col("bank"))), F.lit(False))
        touched = (bank.batch_id == other.batch_id) & (bank.bin == other.bin) & F.expr("txn_date between date_sub(b_date, 10) and b_date and net <= target and coalesce(currency = b_currency, true)") & (larger("size", "by") != larger("size0", "by0"))
        again = bank.join(other, touched, "left_semi").select("bank").distinct()
        lists = in_window(bank.join(again, "bank", "left_semi"), pay, taken, top).select("batch_id", "bank", "target", sign, "near")
        lists = written(lists.join(signs.select("bank", F.col("sign").alias("old")), "bank").where(F.col("sign") != F.col("old")).drop("old"), "settle")
        signs = written(signs.join(lists.select("bank"), "bank", "left_anti").unionByName(lists.select("bank", "sign")), "settle")
        now = written(now.join(lists.select("bank"), "bank", "left_anti").unionByName(searched(lists, cap=cap)), "settle")
        before = taken


def variance_queue(t: DataFrame, open_rows: DataFrame, as_of: str) -> DataFrame:
    """Unmatched rows with a category: duplicate, orphan, rounding, timing, unclassified, in this order."""
    full = S.full_ref(F.col("external_ref"))
    keys = t.withColumn("full", full).where("full <> ''").select("batch_id", "source_kind", F.explode(F.array_distinct(F.array("full", S.last8(F.col("full"))))).alias("key"))
    shared = keys.groupBy("batch_id", "key").agg(F.min("source_kind").alias("a"), F.max("source_kind").alias("b")).where("a <> b").select("batch_id", "key")
    seen = open_rows.withColumn("full", full).select("txn_id", "batch_id", F.explode(F.array_distinct(F.array("full", S.last8(F.col("full"))))).alias("key")).join(shared, ["batch_id", "key"]).select("txn_id", F.lit(True).alias("seen")).distinct()
    twins = t.groupBy("batch_id", "source_kind", "external_ref", "amount_paise").agg(F.count("*").alias("twins")).where("twins > 1")
    rows = open_rows.join(twins, ["batch_id", "source_kind", "external_ref", "amount_paise"], "left").join(seen, "txn_id", "left")
    has = F.coalesce("external_ref", F.lit("")) != ""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("txn_date"))
    category = F.when(has & (F.col("twins") > 1), "duplicate_suspect").when(has & F.col("seen").isNull(), "missing_counterpart").when(F.abs("amount_paise") < 100, "residual_rounding").when(age <= 5, "timing").otherwise("unclassified")
    return rows.select("txn_id", "batch_id", "amount_paise", category.alias("category"))


def pair_scores(members: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs of group members against the answer key (txn_id, truth_group), counted without listing pairs."""
    pairs = lambda c: (F.col(c) * (F.col(c) - 1) / 2).cast("long")
    own = members.select("txn_id", "group_id").join(truth, "txn_id")
    made = own.groupBy("group_id").agg(F.count("*").alias("n")).agg(F.sum(pairs("n")).alias("made"))
    right = own.where("truth_group is not null").groupBy("group_id", "truth_group").agg(F.count("*").alias("n")).agg(F.sum(pairs("n")).alias("tp"))
    wanted = truth.where("truth_group is not null").groupBy("truth_group").agg(F.count("*").alias("n")).agg(F.sum(pairs("n")).alias("true_pairs"))
    out = made.crossJoin(right).crossJoin(wanted)  # one row each
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    p, r = ratio(F.col("tp"), F.col("made")), ratio(F.col("tp"), F.col("true_pairs"))
    return out.select("tp", (F.col("made") - F.col("tp")).alias("fp"), (F.col("true_pairs") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"))
