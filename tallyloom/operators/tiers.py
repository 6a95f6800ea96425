"""Tiers 3 and 4 on top of groups that earlier tiers made: fee groups, fee attach, refund merge, settlement absorption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.corpus import guarded
from .match import attached, cluster_members, exact_members, fee_pairs, refund_pairs, source_rank, unmatched
from .replay import first_of_kinds, sole_places
from .shared import written


def fee_groups(open_rows: DataFrame) -> DataFrame:
    """Tier 3 new groups (group_id, txn_id, label): each open gateway row takes the first free row of each other source.

    Gateway rows come in txn_id order; a group that only equal amounts hold together is dropped
    and its rows stay free.
    """
    taken = written(first_of_kinds(fee_pairs(open_rows, open_rows)), "fee_taken")
    group = F.concat(F.lit("t3:"), "g").alias("group_id")
    heads = taken.select("g").distinct().select(group, F.col("g").alias("txn_id"), F.lit(None).cast("string").alias("label"))
    return heads.unionByName(taken.select(group, F.col("o").alias("txn_id"), "label"))


def fee_attached(orphans: DataFrame, members: DataFrame) -> DataFrame:
    """Tier 3 attach (txn_id, group_id): orphans whose amount a deduction from one group's gateway row explains."""
    first = members.where("source_kind = 'gateway'").withColumn("rn", F.row_number().over(W.partitionBy("group_id").orderBy("txn_id"))).where("rn = 1")
    pairs = fee_pairs(first, orphans).where("label <> 'gross'")
    kinds = members.groupBy("group_id").agg(F.collect_set("source_kind").alias("kinds"))
    edges = pairs.join(first.select(F.col("txn_id").alias("g"), "group_id"), "g").join(kinds, "group_id").where(~F.array_contains("kinds", F.col("source_kind")))
    return sole_places(edges.select(F.col("o").alias("txn_id"), "source_kind", "group_id"))


def refund_merges(members: DataFrame, days: int = 30) -> DataFrame:
    """(refund_group, group_id): groups of negative rows and the one group of positive rows they give money back for.

    The refund's reference holds the original's (3 characters at least), is no larger, and comes
    0 to `days` days later; a missing date is no obstacle. Containment is an equi-join: the
    refund's pieces of each length that originals of its batch have.
    """
    place = F.row_number().over(W.partitionBy("group_id").orderBy(source_rank(), "txn_id"))
    amount = F.coalesce("amount_paise", F.lit(0))
    signs = [f(amount).over(W.partitionBy("group_id")).alias(n) for f, n in ((F.min, "least"), (F.max, "most"))]
    heads = guarded(members).select("batch_id", "group_id", S.full_ref(F.col("external_ref")).alias("ref"), amount.alias("amount"), "txn_date", place.alias("rn"), *signs).where("rn = 1")
    original = heads.where("least > 0 and length(ref) >= 3").select("batch_id", F.col("ref").alias("piece"), "group_id", F.col("amount").alias("paid"), F.col("txn_date").alias("paid_on"))
    sizes = original.select("batch_id", F.length("piece").alias("size")).distinct()
    refund = heads.where("most < 0").select("batch_id", "ref", F.col("group_id").alias("refund_group"), (-F.col("amount")).alias("back"), F.col("txn_date").alias("back_on"))
    pieces = F.transform(F.sequence(F.lit(1), F.length("ref") - F.col("size") + 1), lambda i: F.substr("ref", i, F.col("size")))
    dealt = refund.join(sizes, "batch_id").where("size <= length(ref)").withColumn("piece", F.explode(F.array_distinct(pieces)))
    found = dealt.join(original, ["batch_id", "piece"]).where("back <= paid")
    found = found.where(F.coalesce(F.datediff("back_on", "paid_on").between(0, days), F.lit(True)))
    return found.groupBy("refund_group").agg(F.count_distinct("group_id").alias("n"), F.min("group_id").alias("group_id")).where("n = 1").drop("n")


def with_refunds(members: DataFrame) -> DataFrame:
    """members with refund groups moved into the groups they belong to."""
    moves = refund_merges(members).select(F.col("refund_group").alias("group_id"), F.col("group_id").alias("into"))
    return members.join(moves, "group_id", "left").withColumn("group_id", F.coalesce("into", "group_id")).drop("into")


def earlier_members(t: DataFrame) -> DataFrame:
    """Records with group_id of tiers 1 to 3 in a row: exact, clusters, attach, fee groups, fee attach (to groups of tiers 1 and 2), loose refunds, refund merges."""
    found = written(exact_members(t), "members")
    more = lambda df: found.unionByName(written(t.join(df.select("txn_id", "group_id"), "txn_id").select(*found.columns), "members"))
    for step in (cluster_members, lambda df: attached(df, found)):
        found = more(step(unmatched(t, found)))
    before = found
    for step in (fee_groups, lambda df: fee_attached(df, before), loose_refunds):
        found = more(step(unmatched(t, found)))
    return written(with_refunds(found), "members")


def loose_refunds(open_rows: DataFrame) -> DataFrame:
    """Tier 3 groups (group_id, txn_id) of an open row and the open refund that takes it."""
    pairs = refund_pairs(open_rows)
    return pairs.select(F.concat(F.lit("t3:"), "original").alias("group_id"), F.explode(F.array("original", "refund")).alias("txn_id"))


def settlement_members(t: DataFrame, members: DataFrame) -> DataFrame:
    """Tier 4 by id: (group_id, txn_id, absorbed) of open bank credits, their payments and all rows of the payments' groups.

    absorbed is the group a row came from. A row that several credits claim goes to the least txn_id.
    """
    bank = unmatched(guarded(t).where("source_kind = 'bank' and settlement_id is not null"), members).select("batch_id", "settlement_id", F.col("txn_id").alias("bank"))
    paid = t.where("source_kind = 'gateway' and settlement_id is not null").select("batch_id", "settlement_id", "txn_id")
    return absorbing(bank.join(paid, ["batch_id", "settlement_id"]).select("bank", "txn_id"), members)


def absorbing(paid: DataFrame, members: DataFrame) -> DataFrame:
    """(group_id, txn_id, absorbed): bank credits of paid (bank, txn_id), their payments and all rows of the payments' groups."""
    own = members.select("txn_id", F.col("group_id").alias("absorbed"))
    picked = paid.join(own, "txn_id", "left").select("bank", "txn_id", "absorbed")
    whole = picked.where("absorbed is not null").select("bank", "absorbed").distinct().join(own, "absorbed")
    claims = picked.unionByName(whole.select("bank", "txn_id", "absorbed"))
    rows = claims.where("txn_id <> bank").groupBy("txn_id").agg(F.min("bank").alias("bank"), F.min("absorbed").alias("absorbed"))
    heads = rows.select("bank").distinct().select("bank", F.col("bank").alias("txn_id"), F.lit(None).cast("string").alias("absorbed"))
    return rows.select("bank", "txn_id", "absorbed").unionByName(heads).select(F.concat(F.lit("t4:"), "bank").alias("group_id"), "txn_id", "absorbed")


def scores_by_tier(members: DataFrame, truth: DataFrame) -> DataFrame:
    """Per tier: groups, rows, pairs, right and wrong pairs, counted without listing pairs. members: tier, group_id, txn_id."""
    pairs = lambda c: (F.col(c) * (F.col(c) - 1) / 2).cast("long")
    own = members.select("tier", "group_id", "txn_id").join(truth, "txn_id")
    cells = own.groupBy("tier", "group_id", "truth_group").agg(F.count("*").alias("m"))
    right = F.sum(F.when(F.col("truth_group").isNotNull(), pairs("m")).otherwise(0)).alias("right")
    groups = cells.groupBy("tier", "group_id").agg(F.sum("m").alias("n"), right)
    out = groups.groupBy("tier").agg(F.count("*").alias("groups"), F.sum("n").alias("member_rows"), F.sum(pairs("n")).alias("pairs"), F.sum("right").alias("tp"))
    return out.withColumn("fp", F.col("pairs") - F.col("tp"))


def running(rows: DataFrame, keys: list[str], order: list, values: dict) -> DataFrame:
    """rows with, for each name, the sum of a value over the key's rows up to this one, and name_all, the sum over all of them.

    Rows are dealt by ranges of key and order; a row's sum is that inside its range after those of the
    key's ranges before, so a key of many rows is not one task. order must tell rows apart; null
    keys are one key, null values are 0.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.withColumns({f"__v_{n}": v for n, v in values.items()})
    dealt = written(named.repartitionByRange(ranges, *keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    own = dealt.groupBy(*keys, "__range").agg(*(F.coalesce(F.sum(f"__v_{n}"), F.lit(0)).alias(n) for n in values))
    past, all_of = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*keys)
    sums = [x for n in values for x in (F.coalesce(F.sum(n).over(past), F.lit(0)).alias(f"__past_{n}"), F.sum(n).over(all_of).alias(f"{n}_all"))]
    places = own.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__range").alias("__at"), *sums)
    same = F.col("__range") == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    inside = W.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = [x for n in values for x in ((F.col(f"__past_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0))).alias(n), F.col(f"{n}_all"))]
    return dealt.join(places, same).select(*rows.columns, *out)


def chunked(rows: DataFrame, keys: list[str], order: list, most: int = 10, least: int = 5) -> DataFrame:
    """rows with a chunk number per key: chunks of `most` rows; a tail shorter than `least` takes rows of the chunk before.

    order must tell rows apart; null keys are one key.
    """
    i, n = F.col("__i") - 1, F.col("__i_all")
    short = (n > most) & (n % most).between(1, least - 1)
    chunk = F.when(short & (i >= n - least), F.floor(n / most)).otherwise(F.floor(i / most))
    return running(rows, keys, order, {"__i": F.lit(1)}).select(*rows.columns, chunk.cast("long").alias("chunk"))
