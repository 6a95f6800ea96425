"""Reads of single things: a record as a model may see it, a batch's funnel, batches in an order, the worst written rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: The fields of a record's detail; description and raw are redacted.
DETAIL = ["txn_id", "source_kind", "external_ref", "amount_paise", "fee_paise", "tax_paise", "net_paise", "txn_date", "value_date", "description", "counterparty", "raw"]


def record_details(t: DataFrame) -> DataFrame:
    """The twelve fields of each record, without the answer key; the query fails if a mark of it is left. raw is a map of texts."""
    seen = t.withColumns({"description": S.redacted_description(F.col("description")), "raw": S.redacted_raw(F.col("raw"))}).select(*DETAIL)
    return seen.where(S.no_leak(F.struct(*DETAIL)))


def ugliness(description: Column, *amounts: Column) -> Column:
    """Ten for each comma and one for each character of the amounts as written, and one for each 20 characters of the description."""
    text = F.concat(*(F.coalesce(a, F.lit("")) for a in amounts))
    return (10 * F.regexp_count(text, F.lit(",")) + F.length(text) + F.floor(F.length(F.coalesce(description, F.lit(""))) / 20)).cast("long")


def ugliest(rows: DataFrame, key: str, description: Column, amounts: list[Column], n: int = 5) -> DataFrame:
    """The n rows whose text is furthest from plain, with ugliness; of equal ones the least key first."""
    return rows.withColumn("ugliness", ugliness(description, *amounts)).orderBy(F.desc("ugliness"), key).limit(n)


#: What batches can be ordered by, and the column it reads.
ORDERS = {"created": "created_at", "unexplained": "unexplained_paise", "open": "open_rows", "records": "records"}


def batch_order(batches: DataFrame, by: str = "created", ascending: bool = False) -> DataFrame:
    """Batches by one of ORDERS; no unexplained money is 0, and of equal ones the least batch_id comes first."""
    key = F.coalesce(ORDERS[by], F.lit(0)) if by == "unexplained" else F.col(ORDERS[by])
    return batches.orderBy(key.asc() if ascending else key.desc(), "batch_id")


def batch_funnel(t: DataFrame, members: DataFrame, queue: DataFrame) -> DataFrame:
    """Per batch the lines of its funnel: all records (place 0), each tier, and the queue (place 99).

    members: batch_id, group_id, tier, strategy, txn_id, amount_paise, of which members are counted
    and a group's residual is its spread of amounts; a tier's strategy is that of its last group.
    queue: batch_id, variance_paise. The queue's records are those in no group.
    """
    groups = members.groupBy("batch_id", "tier", "group_id").agg(F.count("*").alias("n"), F.max("strategy").alias("strategy"), (F.max("amount_paise") - F.min("amount_paise")).alias("residual"))
    tiers = groups.groupBy("batch_id", "tier").agg(F.count("*").alias("groups"), F.sum("n").alias("records"), F.max_by("strategy", "group_id").alias("strategy"), F.sum("residual").alias("residual_paise"))
    tiers = tiers.select("batch_id", F.col("tier").cast("int").alias("place"), F.concat(F.lit("Tier "), F.col("tier").cast("string")).alias("label"), "groups", "records", "strategy", "residual_paise")
    whole = t.groupBy("batch_id").agg(F.count("*").alias("records"))
    matched = tiers.groupBy("batch_id").agg(F.sum("records").alias("matched"))
    waiting = queue.groupBy("batch_id").agg(F.count("*").alias("groups"), F.sum(F.abs("variance_paise")).alias("residual_paise"))
    zero = F.lit(0).cast("long")
    first = whole.select("batch_id", F.lit(0).alias("place"), F.lit("Records ingested").alias("label"), F.lit(None).cast("long").alias("groups"), "records", F.lit("gateway + bank + ledger").alias("strategy"), zero.alias("residual_paise"))
    rest = whole.join(matched, "batch_id", "left").join(waiting, "batch_id", "left")
    last = rest.select("batch_id", F.lit(99).alias("place"), F.lit("Variance queue").alias("label"), F.coalesce("groups", zero).alias("groups"), (F.col("records") - F.coalesce("matched", zero)).alias("records"), F.lit("unmatched records + unbalanced groups").alias("strategy"), F.coalesce("residual_paise", zero).alias("residual_paise"))
    return first.unionByName(tiers).unionByName(last)
