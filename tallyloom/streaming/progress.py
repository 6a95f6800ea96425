"""Progress and silence of batches as keyed state, and late rows kept apart.

`Progress` holds for each batch the steps it has gone through and its last activity. A step is
given out once, when it is first seen; a timer in event time gives the batch out as idle once the
watermark has passed its last activity by `minutes` and no final step came. State and timers lie in
the checkpoint, so a restarted stream goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .live import daily

OUT = "batch_id string, kind string, step string, at timestamp, steps int"


class Progress(StatefulProcessor):
    """Keyed by batch_id. In: step, created_at. Out: (batch_id, 'step' or 'idle', step, time, steps so far)."""

    def __init__(self, final: list[str], minutes: int = 30):
        self.final, self.quiet = set(final), minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "step string", "at timestamp")
        self.last = handle.getValueState("last", "at timestamp, over boolean")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        last, over = self.last.get() if self.last.exists() else (None, False)
        done = sum(1 for _ in self.steps.keys())
        out = []
        for pdf in rows:
            for step, at in sorted(zip(pdf["step"], pdf["created_at"]), key=lambda r: (r[1], str(r[0]))):
                last = at if last is None or at > last else last
                if step is not None and not self.steps.containsKey((step,)):
                    self.steps.updateValue((step,), (at.to_pydatetime(),))
                    done += 1
                    out.append((key[0], "step", step, at, done))
                    over = over or step in self.final
        last = pd.Timestamp(last)
        self.last.update((last.to_pydatetime(), over))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if not over:
            self.handle.registerTimer(int(last.timestamp() * 1000) + self.quiet)
        yield pd.DataFrame(out, columns=["batch_id", "kind", "step", "at", "steps"]).astype({"at": "datetime64[ns]", "steps": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        last, over = self.last.get()
        done = sum(1 for _ in self.steps.keys())
        rows = [] if over else [(key[0], "idle", None, pd.Timestamp(last), done)]
        yield pd.DataFrame(rows, columns=["batch_id", "kind", "step", "at", "steps"]).astype({"at": "datetime64[ns]", "steps": "int32"})

    def close(self) -> None:
        pass


def progress_stream(audit: DataFrame, final: list[str], minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """A stream of audit rows (batch_id, step, created_at) to the steps and silences of batches. Needs the RocksDB state store."""
    rows = audit.select("batch_id", "step", F.col("created_at").cast("timestamp").alias("created_at")).where("batch_id is not null and created_at is not null")
    keyed = rows.withWatermark("created_at", late).groupBy("batch_id")
    return keyed.transformWithStateInPandas(Progress(final, minutes), OUT, "Append", "EventTime")


def steps_done(audit: DataFrame) -> DataFrame:
    """The batch form of the steps: each batch's steps with the time each was first seen."""
    rows = audit.where("batch_id is not null and created_at is not null and step is not null")
    return rows.groupBy("batch_id", "step").agg(F.min("created_at").alias("at"))


def fallen_silent(audit: DataFrame, final: list[str], minutes: int = 30) -> DataFrame:
    """The batch form of the silences: every pause of `minutes` or more of a batch before its first final step, by its last activity.

    The newest row of the whole log is what the silence of a last activity is measured against.
    """
    from pyspark.sql import Window as W

    at = F.col("created_at").cast("timestamp")
    rows = audit.where("batch_id is not null and created_at is not null").select("batch_id", at.alias("at"), F.coalesce(F.col("step").isin(final), F.lit(False)).alias("final"))
    w = W.partitionBy("batch_id").orderBy("at")
    seen = rows.groupBy("batch_id", "at").agg(F.max("final").alias("final"))
    seen = seen.withColumn("next", F.lead("at").over(w)).withColumn("over", F.max("final").over(w.rowsBetween(W.unboundedPreceding, 0)))
    newest = rows.agg(F.max("at").alias("newest"))
    gap = F.unix_micros(F.coalesce("next", "newest")) - F.unix_micros("at")
    return seen.crossJoin(F.broadcast(newest)).where(~F.col("over")).where(gap >= minutes * 60_000_000).select("batch_id", "at")


def ingest_by_lateness(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, column: str = "ts", late_seconds: int = 86_400) -> StreamingQuery:
    """Takes new files; rows of a micro-batch that are behind the newest row of all earlier ones by more than late_seconds go to sink/late, others to sink/rows.

    Each micro-batch writes its own partition of rows, late and newest (its newest time), so a
    repeated one overwrites itself and decides alike; no row is lost, and later ones can be counted in.
    """
    newest = f"{sink}/newest"

    def write(df: DataFrame, number: int) -> None:
        rows = df.withColumn("batch", F.lit(number))
        path = spark._jvm.org.apache.hadoop.fs.Path(newest)
        known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        seen = spark.read.schema("newest timestamp, batch int").parquet(newest).where(F.col("batch") < number) if known else spark.createDataFrame([], "newest timestamp, batch int")
        mark = seen.agg((F.max("newest") - F.make_dt_interval(secs=F.lit(late_seconds))).alias("mark"))
        told = rows.crossJoin(F.broadcast(mark)).withColumn("late", F.coalesce(F.col(column).cast("timestamp") < F.col("mark"), F.lit(False))).drop("mark")
        put = lambda part, name: part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{sink}/{name}")
        put(told.where("late").drop("late"), "late")
        put(told.where("not late").drop("late"), "rows")
        put(rows.groupBy("batch").agg(F.max(F.col(column).cast("timestamp")).alias("newest")), "newest")

    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_days(spark: SparkSession, sink: str, schema, with_late: bool = False) -> DataFrame:
    """The daily counts of what ingest_by_lateness kept as rows, or of these and the late ones."""
    names = ("rows", "late") if with_late else ("rows",)
    parts = [spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sink}/{n}") for n in names]
    return daily(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
