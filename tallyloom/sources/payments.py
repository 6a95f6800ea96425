"""Gateway payments and settlements: a paged source, projections to records, and range ingest."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .files import new_rows

PAGE = 100


def _with(df: DataFrame, kind: str, fee: str, net) -> DataFrame:
    who = F.coalesce(F.nullif(F.col("email"), F.lit("")), F.col("contact")) if "email" in df.columns else F.lit(None).cast("string")
    day = F.to_date(F.timestamp_seconds("created_at"))
    return df.select(F.col("id").alias("external_ref"), F.lit(kind).alias("source_kind"), F.col("amount").alias("amount_paise"), F.col(fee).alias("fee_paise"), F.col("tax").alias("tax_paise"), net.alias("net_paise"), who.alias("counterparty"), day.alias("txn_date"))


def payments_as_txns(payments: DataFrame) -> DataFrame:
    """Payments (id, amount, fee, tax, email, contact, created_at in seconds) as records; the fee already holds the tax."""
    return _with(payments, "gateway", "fee", F.when(F.col("amount").isNotNull() & F.col("fee").isNotNull(), F.col("amount") - F.col("fee")))


def settlements_as_txns(settlements: DataFrame) -> DataFrame:
    """Settlements (id, amount, fees, tax, utr, created_at) as records: the amount is net, the value date the day itself."""
    out = _with(settlements, "gateway", "fees", F.col("amount"))
    return out.withColumn("value_date", F.col("txn_date"))


def by_status(payments: DataFrame) -> DataFrame:
    return payments.groupBy(F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def in_days(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Rows created from the start of the first day to the last second of the last (UTC)."""
    start, stop = (F.unix_seconds(F.to_utc_timestamp(F.lit(x), "UTC")) for x in (f"{first} 00:00:00", f"{last} 23:59:59"))
    return rows.where(F.col("created_at").between(start, stop))


def range_summary(payments: DataFrame, stored: DataFrame, first: str, last: str) -> DataFrame:
    """Per status: payments of the days, and those whose source and reference are not stored yet. stored: source_kind, external_ref."""
    rows = in_days(payments, first, last)
    keys = stored.where("source_kind = 'gateway'").select(F.col("external_ref").alias("id")).distinct().withColumn("old", F.lit(1))
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown")).alias("status")
    return rows.join(keys, "id", "left").groupBy(status).agg(F.count("*").alias("fetched"), F.count_if(F.col("old").isNull()).alias("added"))


def settlement_rows(spark: SparkSession, url: str, settlement: str, schema: str, page: int = PAGE) -> DataFrame:
    """A settlement's rows: its own record names the UTC day, of whose combined rows those with its id are kept. schema must have settlement_id."""
    with urllib.request.urlopen(f"{url}/settlements/{urllib.parse.quote(settlement, safe='')}", timeout=30) as reply:
        created = json.load(reply).get("created_at")
    if created is None:
        raise ValueError(f"settlement {settlement} has no created_at")
    spark.dataSource.register(PagedSource)
    day = time.gmtime(created)
    asked = json.dumps({"year": day.tm_year, "month": day.tm_mon, "day": day.tm_mday})
    rows = spark.read.format("paged").schema(schema).options(url=f"{url}/settlements/recon/combined", page=str(page), query=asked).load()
    return of_settlement(rows, settlement)


def of_settlement(rows: DataFrame, settlement: str) -> DataFrame:
    """The combined rows of a settlement's day that belong to it."""
    return rows.where(F.col("settlement_id") == settlement)


class Day(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class PagedReader(DataSourceReader):
    """Asks a URL for pages of at most `page` items, one partition per day, until a page is short.

    With the option `query` (a JSON object) its parameters are sent instead of days, by one partition.
    """

    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.url, self.page = options["url"], int(options.get("page", PAGE))
        self.fixed = json.loads(options["query"]) if "query" in options else None
        self.first, self.last = int(options.get("from", 0)), int(options.get("to", -1))

    def partitions(self):
        if self.fixed is not None:
            return [Day(0, 0)]
        return [Day(a, min(a + 86399, self.last)) for a in range(self.first, self.last + 1, 86400)]

    def read(self, day):
        skip = 0
        while True:
            asked = {"from": day.start, "to": day.stop} if self.fixed is None else self.fixed
            query = urllib.parse.urlencode(asked | {"count": self.page, "skip": skip})
            with urllib.request.urlopen(f"{self.url}?{query}", timeout=30) as reply:
                items = json.load(reply)["items"]
            for item in items:
                yield tuple(item.get(n) for n in self.names)
            skip += len(items)
            if len(items) < self.page:
                return


class PagedSource(DataSource):
    """spark.read.format("paged").schema(...).options(url=..., **{"from": seconds, "to": seconds}).load()"""

    @classmethod
    def name(cls):
        return "paged"

    def reader(self, schema):
        return PagedReader(schema, self.options)

    def streamReader(self, schema):
        return PagedStream(schema, self.options)


class PagedStream(DataSourceStreamReader):
    """The pages of what was created after the cursor, up to now (or the option `until`).

    The cursor is a time in seconds, held by the stream's checkpoint, and the next look begins one
    second after it; the first begins `lookback` days (30) before now. With `late` seconds, each
    look begins so much earlier: what it brings again the ingest must drop by key.
    """

    def __init__(self, schema, options):
        self.pages = PagedReader(schema, dict(options) | {"from": "0", "to": "-1"})
        self.until, self.lookback, self.late = options.get("until"), int(options.get("lookback", 30)), int(options.get("late", 0))

    def _now(self) -> int:
        return int(self.until) if self.until else int(time.time())

    def initialOffset(self):
        return {"seconds": self._now() - self.lookback * 86400}

    def latestOffset(self):
        return {"seconds": self._now()}

    def partitions(self, start, end):
        first, last = start["seconds"] + 1 - self.late, end["seconds"]
        return [Day(a, min(a + 86399, last)) for a in range(first, last + 1, 86400)] if start["seconds"] < last else []

    def read(self, partition):
        return self.pages.read(partition)

    def commit(self, end):
        pass


def ingest_payments(spark: SparkSession, stream: DataFrame, batch_id: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Takes the stream's payments as records of a batch, each reference once, whatever is looked at or written again.

    Every micro-batch is one partition of the sink and leaves out what other micro-batches hold.
    """

    def write(df: DataFrame, number: int) -> None:
        rows = payments_as_txns(df.dropDuplicates(["id"])).select(F.lit(batch_id).alias("batch_id"), "*")
        path = spark._jvm.org.apache.hadoop.fs.Path(sink)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            rows = new_rows(rows, spark.read.schema(StructType([*rows.schema.fields]).add("micro", "integer")).parquet(sink).where(F.col("micro") != number))
        rows.withColumn("micro", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("micro").parquet(sink)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
