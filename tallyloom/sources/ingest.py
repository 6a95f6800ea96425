"""The ingest driver of a batch's files: rows, counts and skips in one pass, safe to run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import written
from .files import read_bank_csv, read_ledger_xlsx

#: Skipped lines that the audit log names.
SHOWN = 50


def counts(rows: DataFrame) -> list:
    """Aggregates over rows (external_ref, reason): parsed, skipped, and parsed ones without a reference."""
    good = F.col("reason").isNull()
    return [F.count_if(good).alias("parsed"), F.count_if(~good).alias("skipped"), F.count_if(good & (F.coalesce("external_ref", F.lit("")) == "")).alias("missing_ref")]


def by_source(rows: DataFrame, *keys: str) -> DataFrame:
    """counts() for each key and source_kind."""
    return rows.groupBy(*keys, "source_kind").agg(*counts(rows))


def first_skips(rows: DataFrame, *keys: str, shown: int = SHOWN) -> DataFrame:
    """The first skipped lines of each key and source_kind with their reason, at most `shown`."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(*keys, "source_kind").orderBy("line", "reason"))
    return rows.where("reason is not null").select(*keys, "source_kind", "line", "reason").withColumn("place", place).where(F.col("place") <= shown)


def file_rows(spark: SparkSession, csv: str, xlsx: str) -> DataFrame:
    """source_kind, line, amount_paise, txn_date, external_ref, reason of a bank CSV and a ledger workbook."""
    columns = ["source_kind", "line", "amount_paise", "txn_date", "external_ref", "reason"]
    bank = read_bank_csv(spark, csv).withColumn("source_kind", F.lit("bank"))
    return bank.select(columns).unionByName(read_ledger_xlsx(spark, xlsx).withColumn("source_kind", F.lit("ledger")).select(columns))


def ingest_files(spark: SparkSession, batch_id: str, csv: str, xlsx: str, sink: str) -> dict:
    """Writes a batch's rows to sink/rows and its first skips to sink/skips, and returns the summary.

    A batch is a partition that is written whole, so running it again replaces it and leaves other
    batches alone. Files are read once, and the counts are taken by that pass.
    """
    parsed, seen = file_rows(spark, csv, xlsx).withColumn("batch_id", F.lit(batch_id)), Observation()
    no_ref = F.coalesce("external_ref", F.lit("")) == ""
    named = []
    for kind in ("bank", "ledger"):
        own = F.col("source_kind") == kind
        named += [F.count_if(own & F.col("reason").isNull()).alias(f"{kind}_rows_parsed"), F.count_if(own & F.col("reason").isNotNull()).alias(f"{kind}_rows_skipped"), F.count_if(own & F.col("reason").isNull() & no_ref).alias(f"{kind}_missing_ref")]
    rows = written(parsed.observe(seen, *named), "parsed")
    put = lambda part, name: part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{sink}/{name}")
    put(rows.where("reason is null").drop("reason"), "rows")
    skips = first_skips(rows, "batch_id").orderBy("source_kind", "place").limit(2 * SHOWN)
    put(skips, "skips")
    got = seen.get
    lines = spark.read.parquet(f"{sink}/skips").where(F.col("batch_id") == batch_id).orderBy("source_kind", "place").limit(SHOWN)
    return got | {"total_rows": got["bank_rows_parsed"] + got["ledger_rows_parsed"], "skipped_lines": [r.line for r in lines.collect()]}
