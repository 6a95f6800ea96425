"""CSV files whose quoted fields may hold line ends, read in many tasks per file.

A block is one input split of a file. The first pass gives each block's lines, whether its number of
quotes is odd, and its last line at which a record could begin, for both states it may be
entered in. Running over the blocks of a file then tells each block the state it is entered in, its
first line's number and the line on which a record that is still open began. The second pass
parses the records that lie in one block; pieces of records that cross blocks (at most two a block) are
put together by the line on which they began. A quote inside an unquoted field isn't supported.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.shared import written

#: Blocks whose facts are broadcast (about 100 bytes each).
MOST_BLOCKS = 1_000_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    meta = F.col("_metadata")
    text = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.csv").text(path)
    return text.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), "value")


def _runs(batches, more=()):
    """Yields (file, block, lines, facts) of the blocks of a task in turn."""
    now, own, facts = None, [], None
    for pdf in batches:
        extra = [pdf[c] for c in more]
        for file, block, value, *rest in zip(pdf["file"], pdf["block"], pdf["value"], *extra):
            if (file, block) != now:
                if own:
                    yield *now, own, facts
                now, own, facts = (file, block), [], rest
            own.append(value)
    if own:
        yield *now, own, facts


def blocks(lines: DataFrame) -> DataFrame:
    """file, block, odd (entered inside quotes), first (number of its first line), began (line of the record that is open when it is entered)."""

    def look(batches):
        import pandas as pd

        out = []
        for file, block, own, _ in _runs(batches):
            inside, last = 0, [None, None]  # the last line before which the number of quotes is even, and odd
            for i, line in enumerate(own):
                last[inside] = i
                inside = (inside + line.count('"')) % 2
            out.append((file, block, len(own), inside, *last))
        frame = pd.DataFrame(out, columns=["file", "block", "lines", "turns", "even", "odd_start"])
        yield frame.astype({"even": "Int64", "odd_start": "Int64"})

    found = written(lines.mapInPandas(look, "file string, block long, lines long, turns int, even long, odd_start long"), "csv_blocks")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    told = found.withColumn("odd", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2 == 1).withColumn("first", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    start = F.col("first") + F.when(F.col("odd"), F.col("odd_start")).otherwise(F.col("even"))
    told = told.withColumn("start", start)
    return written(told.withColumn("began", F.last("start", True).over(before)).select("file", "block", "odd", "first", "began"), "csv_blocks")


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, start (number of the record's first line, from 0), line (of its last line, from 1), fields."""
    lines = _lines(spark, path)
    told = blocks(lines)
    if told.count() > MOST_BLOCKS:
        raise ValueError("more blocks than are broadcast: read fewer files at once or raise spark.sql.files.maxPartitionBytes")

    def cut(batches):
        import pandas as pd

        for file, block, own, (odd, first, began) in _runs(batches, ("odd", "first", "began")):
            out, held = [], []
            start, inside, whole = (int(began), 1, False) if odd else (int(first), 0, True)
            for i, line in enumerate(own):
                if not held and not inside:
                    start, whole = int(first) + i, True
                held.append(line)
                inside = (inside + line.count('"')) % 2
                if not inside:
                    out.append((file, start, block, whole, "\n".join(held)))
                    held = []
            if held:
                out.append((file, start, block, False, "\n".join(held)))
            yield pd.DataFrame(out, columns=["file", "start", "block", "whole", "text"])

    pieces = lines.join(F.broadcast(told), ["file", "block"]).mapInPandas(cut, "file string, start long, block long, whole boolean, text string")
    crossing = pieces.where("not whole").groupBy("file", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "\n").alias("text"))
    return pieces.where("whole").select("file", "start", "text").unionByName(crossing.select("file", "start", "text"))


def read(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """file, line and the named columns (as texts) of CSV files whose first record is a header. Blank records are left out."""
    rows = records(spark, path)

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for file, start, text in zip(pdf["file"], pdf["start"], pdf["text"]):
                fields = next(csv.reader(text.split("\n") if "\n" not in text else text.splitlines(True)), [])
                if start == 0:
                    fields = [f.removeprefix("﻿").strip().lower() for f in fields]
                if start == 0 or any(f.strip() for f in fields):
                    out.append((file, start, start + 1 + text.count("\n"), fields))
            yield pd.DataFrame(out, columns=["file", "start", "line", "fields"])

    parsed = written(rows.mapInPandas(parse, "file string, start long, line int, fields array<string>"), "csv_rows")
    header = parsed.where("start = 0").select("file", F.col("fields").alias("header"))
    own = parsed.where("start > 0").join(header, "file")
    value = lambda n: F.get("fields", F.nullif(F.array_position("header", F.lit(n)), F.lit(0)).cast("int") - 1).alias(n)
    return own.select("file", "line", *map(value, names))
