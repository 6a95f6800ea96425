"""Tables kept by batch, whose rows are replaced, changed and removed without touching other batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .shared import removed, written_at

_FOLDER = "__batch"


def _folder():
    """The partition of a batch: its id, or a digest of ids that are no plain file name; null has one of its own."""
    name = F.col("batch_id").cast("string")
    return F.when(name.isNull(), "none").when(name.rlike("^[A-Za-z0-9._-]{1,100}$"), F.concat(F.lit("b"), name)).otherwise(F.concat(F.lit("x"), F.sha2(name, 256)))


class BatchTable:
    """Rows of schema (with batch_id and the column `key`) below path, a partition per batch.

    A change is read and worked out in full in the shared folder before a partition is overwritten,
    and gives the same rows when it is made again; so after a lost executor or driver it is simply
    repeated. Partitions are swapped one by one: a reader may see some batches of a change before
    others, never half a batch's rows. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self._stored = StructType(schema.fields).add(_FOLDER, "string")

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _all(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).parquet(self.path)

    def rows(self) -> DataFrame:
        return self._all().select(*self.schema.names)

    def _overwrite(self, rows: DataFrame) -> None:
        """rows (with their folder) as the whole of their batches; a large batch is written by several tasks."""
        out = rows.hint("rebalance", _FOLDER)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_FOLDER).parquet(self.path)

    def _drop(self, folders: list[str]) -> None:
        for name in folders:
            removed(self.spark, f"{self.path}/{_FOLDER}={name}")

    def replace(self, rows: DataFrame) -> None:
        """The batches that rows hold, with these rows alone; other batches stay."""
        staged, uri = written_at(rows.select(*self.schema.names).withColumn(_FOLDER, _folder()), "replace")
        self._overwrite(staged)
        removed(self.spark, uri)

    def remove(self, batches: DataFrame) -> None:
        """Deletes whole batches. batches: batch_id."""
        self._drop([r[0] for r in batches.select(_folder().alias("f")).distinct().toLocalIterator()])

    def change(self, put: DataFrame | None = None, drop: DataFrame | None = None) -> None:
        """Puts whole rows in by (batch_id, key), for new keys and for held ones, and deletes the keys of drop.

        A key in both is put. Keys put twice are an error. Null keys are equal to each other. Only the
        batches of put and drop are read and written; one that is left without rows goes.
        """
        put = self.spark.createDataFrame([], self.schema) if put is None else put.select(*self.schema.names)
        named = put.withColumn(_FOLDER, _folder())
        fresh, fresh_uri = written_at(named, "put")
        if twice := fresh.groupBy(_FOLDER, self.key).count().where("count > 1").take(1):
            raise ValueError(f"a row is put twice: {twice[0]}")
        keys = fresh.select(F.col(_FOLDER).alias("f"), F.col(self.key).alias("k"))
        if drop is not None:
            keys = keys.unionByName(drop.select(_folder().alias("f"), F.col(self.key).alias("k")))
        keys, keys_uri = written_at(keys.distinct(), "keys")
        folders = [r.f for r in keys.select("f").distinct().toLocalIterator()]
        old = self._all().where(F.col(_FOLDER).isin(folders) if folders else F.lit(False))
        kept = old.join(keys, (old[_FOLDER] == keys.f) & old[self.key].eqNullSafe(keys.k), "left_anti")
        staged, uri = written_at(kept.select(*fresh.columns).unionByName(fresh), "change")
        self._overwrite(staged)
        left = {r[0] for r in staged.select(_FOLDER).distinct().toLocalIterator()}
        self._drop([f for f in folders if f not in left])
        for done in (fresh_uri, keys_uri, uri):
            removed(self.spark, done)

    def follow(self, changes: DataFrame, checkpoint: str, version: str = "version") -> StreamingQuery:
        """Takes a stream of changes: rows of the table and `gone`; the newest version of a key counts.

        version is a column of the table, larger for later changes. A change that is not newer than the
        held row does nothing, so a micro-batch that is given again leaves the table as it is.
        """

        def apply(df: DataFrame, number: int) -> None:
            every = F.struct(*self.schema.names, "gone")
            last = df.groupBy(_folder().alias("f"), F.col(self.key).alias("k")).agg(F.max_by(every, version).alias("r"))
            held = self._all().select(F.col(_FOLDER).alias("hf"), F.col(self.key).alias("hk"), F.col(version).alias("hv"))
            news = last.join(held, (last.f == held.hf) & last.k.eqNullSafe(held.hk), "left").where(F.col("hv").isNull() | (F.col(f"r.{version}") > F.col("hv")))
            news, uri = written_at(news.select("r.*"), "news")
            self.change(news.where("not gone"), news.where("gone"))
            removed(self.spark, uri)

        return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
