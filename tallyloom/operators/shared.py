"""Tables cut from their lineage in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's URI below spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a folder below /tmp is set for the session in local mode (one machine,
    as in tests); on a cluster it is an error, as executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file:///tmp/spark-checkpoint-{uuid.uuid4().hex[:8]}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet in a shared folder and read again: survives lost executors."""
    return written_at(df, what)[0]


def written_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """The same, with the folder's URI, for tables that are removed once the next one stands."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, uri: str) -> None:
    """Deletes a table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
