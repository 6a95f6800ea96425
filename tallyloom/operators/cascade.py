"""All tiers in a row over one table of records, each on what the tiers before left.

A member row holds its group's id, tier, strategy and confidence. Every tier writes one table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import match as M
from . import tiers as T
from .shared import written

#: Strategies and confidences (percent) of the tiers.
EXACT, REFERENCE, FEE, REFUND, SETTLEMENT = "exact_ref_amount_date", "normalised_ref_windowed", "fee_reconstructed", "refund_linked", "aggregate_settlement"
SURE, BASE, FEE_BASE, BY_ID, BY_SEARCH, STEP = 100, 95, 90, 90, 75, 5

_OWN = ("group_id", "tier", "strategy", "confidence_pct")
#: Rows (of an id and up to four short values) that a join may send to every executor.
FEW = 50_000


def _few(df: DataFrame) -> DataFrame:
    """df, sent to every executor if it has few rows, so that the members it is joined with stay where they are."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _named(df: DataFrame, tier: int, strategy: str, confidence) -> DataFrame:
    return df.withColumns({"tier": F.lit(tier), "strategy": F.lit(strategy), "confidence_pct": F.lit(confidence).cast("int") if isinstance(confidence, int) else confidence.cast("int")})


def _looseness(members: DataFrame) -> DataFrame:
    """(group_id, confidence_pct): 95 less 5 for each of normalised reference, amount and date that differs; null is a value."""
    differs = lambda c: (F.size(F.collect_set(F.struct(c))) > 1).cast("int")
    full = F.nullif(F.col("external_ref"), F.lit(""))
    rows = members.select("group_id", S.full_ref(full).alias("ref"), "amount_paise", "txn_date")
    return rows.groupBy("group_id").agg((F.lit(BASE) - STEP * (differs("ref") + differs("amount_paise") + differs("txn_date"))).cast("int").alias("confidence_pct"))


def _changed(members: DataFrame, groups: DataFrame) -> DataFrame:
    """members with the tier, strategy or confidence that groups (group_id and some of them) give."""
    new = [c for c in groups.columns if c != "group_id"]
    given = written(groups.select("group_id", *(F.col(c).alias(f"new_{c}") for c in new)), "groups")
    return members.join(_few(given), "group_id", "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in new}).select(*members.columns)


def _added(members: DataFrame, t: DataFrame, found: DataFrame) -> DataFrame:
    """members and the records of found (txn_id, group_id, tier, strategy, confidence_pct), of which only these are written."""
    return members.unionByName(written(t.join(found.select("txn_id", *_OWN), "txn_id").select(*members.columns), "members"))


def _attached(members: DataFrame, t: DataFrame, found: DataFrame) -> DataFrame:
    """members and the records of found (txn_id, group_id), which take over their group's tier, strategy and confidence."""
    groups = _few(written(found.select("group_id").distinct(), "groups"))
    return _added(members, t, found.join(members.select(*_OWN).join(groups, "group_id", "left_semi").distinct(), "group_id"))


def _fee_exact(amount, gross, fee, tax):
    return F.coalesce(amount.isin(gross, gross - fee) | (amount == gross - fee - tax), F.lit(False))


def _fee_confidence(exact):
    return F.when(exact, FEE_BASE).otherwise(FEE_BASE - STEP)


def _first_gateway(members: DataFrame) -> DataFrame:
    rows = members.where("source_kind = 'gateway'").groupBy("group_id").agg(F.min_by(F.struct("amount_paise", "fee_paise", "tax_paise"), "txn_id").alias("g"))
    return rows.select("group_id", F.col("g.amount_paise").alias("gross"), F.col("g.fee_paise").alias("fee"), F.col("g.tax_paise").alias("tax"))


def _fee_tier(members: DataFrame, t: DataFrame) -> DataFrame:
    """Fee groups among open rows; open rows to groups of earlier tiers, which become tier 3 by their last row; refunds of loose rows."""
    groups = written(T.fee_groups(M.unmatched(t, members)), "fee_groups")
    sure = groups.where("label <> 'gross'").groupBy("group_id").agg(F.min_by("label", "txn_id").alias("label"))
    made = groups.select("txn_id", "group_id").join(sure, "group_id")
    found = _added(members, t, _named(made, 3, FEE, _fee_confidence(F.col("label") != "gross_minus_fee_plus_tax")))

    places = written(T.fee_attached(M.unmatched(t, found), members), "places")
    late = places.join(t.select("txn_id", "amount_paise"), "txn_id").join(_first_gateway(members), "group_id")
    exact = _fee_exact(F.col("amount_paise"), F.col("gross"), F.col("fee"), F.col("tax"))
    last = late.groupBy("group_id").agg(F.max_by(exact, "txn_id").alias("exact"))
    found = _attached(found, t, places)
    found = written(_changed(found, _named(last, 3, FEE, _fee_confidence(F.col("exact"))).drop("exact")), "members")

    return _added(found, t, _named(T.loose_refunds(M.unmatched(t, found)), 3, FEE, FEE_BASE))


def _refund_tier(members: DataFrame) -> DataFrame:
    """Refund groups move into their originals' groups, which keep their confidence."""
    moves = written(T.refund_merges(members), "moves")
    into = moves.select(F.col("refund_group").alias("group_id"), F.col("group_id").alias("into"))
    targets = moves.select("group_id").distinct().join(members.select("group_id", "confidence_pct").distinct(), "group_id")
    moved = members.join(into, "group_id", "left").withColumn("group_id", F.coalesce("into", "group_id")).drop("into").select(*members.columns)
    return written(_changed(moved, _named(targets, 3, REFUND, F.col("confidence_pct"))), "members")


def _taken_over(members: DataFrame, t: DataFrame, settled: DataFrame, confidence: int) -> DataFrame:
    """Rows of settled (group_id, txn_id) leave their groups for these."""
    return written(_added(M.unmatched(members, settled), t, _named(settled.select("group_id", "txn_id"), 4, SETTLEMENT, confidence)), "members")


def run(t: DataFrame) -> DataFrame:
    """Members (columns of t, group_id, tier, strategy, confidence_pct) of all groups after exact, reference, fee, refund and settlement tiers."""
    found = written(_named(M.exact_members(t), 1, EXACT, SURE), "members")
    pairs = written(M.cluster_members(M.unmatched(t, found)), "clusters")
    found = _added(found, t, _named(pairs.select("txn_id", "group_id").join(_looseness(pairs), "group_id"), 2, REFERENCE, F.col("confidence_pct")))
    places = written(M.attached(M.unmatched(t, found), found), "places")
    found = _attached(found, t, places)
    touched = _few(written(places.select("group_id").distinct(), "groups"))
    found = written(_changed(found, _looseness(found.join(touched, "group_id", "left_semi"))), "members")
    found = _refund_tier(_fee_tier(found, t))
    searched = written(M.settled_rows(t, found), "settled")
    found = _taken_over(found, t, written(T.settlement_members(t, found), "settled"), BY_ID)
    return _taken_over(found, t, written(T.absorbing(searched.select("bank", "txn_id"), found), "settled"), BY_SEARCH)


def report(t: DataFrame, members: DataFrame) -> DataFrame:
    """Per tier and strategy: groups, rows and money; tier 0 is what stays open. The rows and money of all lines are those of t."""
    per = members.groupBy("tier", "strategy").agg(F.count_distinct("group_id").alias("groups"), F.count("*").alias("member_rows"), F.sum("amount_paise").alias("net_paise"))
    rest = M.unmatched(t, members).agg(F.count("*").alias("member_rows"), F.sum("amount_paise").alias("net_paise"))
    return per.unionByName(rest.select(F.lit(0).alias("tier"), F.lit("open").alias("strategy"), F.lit(0).cast("long").alias("groups"), "member_rows", "net_paise"))


def unsettled(t: DataFrame, members: DataFrame, top: int = M.TOP, cap: int = M.CAP) -> DataFrame:
    """Bank rows that all tiers left open, with what the search had: payments in the window, and why it found nothing.

    no_payments: none in the window; over_cap: the amount is above what is searched; some_left_out:
    more payments than are searched; no_subset_found: all were searched without one answer.
    """
    bank, pay = M.open_settlements(t, members)
    seen = M.in_window(bank, pay, top=1).select("batch_id", "bank", "target", F.col("seen").alias("payments"))
    why = F.when(F.col("payments") == 0, "no_payments").when(F.col("target") > cap, "over_cap").when(F.col("payments") > top, "some_left_out").otherwise("no_subset_found")
    return seen.select("bank", "batch_id", "target", "payments", why.alias("reason"))
