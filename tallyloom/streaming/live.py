"""Incremental ingest, daily rollup and idle detection with Structured Streaming.

The checkpoint is the cursor: a file is taken once, and a batch is written under an id made of
its number, so a replayed batch overwrites itself. Late rows are bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily(events: DataFrame) -> DataFrame:
    """Tumbling windows of a day: counts by kind and sum of values."""
    day = F.window("ts", "1 day")
    return events.groupBy(day.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("paise")).select(F.col("w.start").cast("date").alias("day"), "n", "purchases", "errors", "paise")


def ingest(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Takes all files that the cursor hasn't passed, then stops, or looks again after each `every` (such as 15 minutes), one look at a time. Each micro-batch is one partition of the sink."""

    def write(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)

    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def daily_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    return daily(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late))


def idle(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Per key: sessions (gaps of over `minutes`), last activity and minutes since, against the newest event."""
    sessions = events.groupBy("user_id", F.session_window("ts", f"{minutes} minutes")).agg(F.count("*").alias("n"))
    per = sessions.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))
    last = events.groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    newest = events.agg(F.max("ts").alias("now"))
    gap = F.floor((F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 60_000_000)
    return per.join(last, "user_id").crossJoin(F.broadcast(newest)).select("user_id", "sessions", "events", gap.alias("idle_minutes"), (gap > minutes).alias("idle"))
