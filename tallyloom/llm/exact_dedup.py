"""Exact dedup over an extendible-hash index on shared files. DataFrame functions only.

Texts are equal when identical after each run of ASCII white space became one space (null is
empty). The index has three parts:

* postings: doc_id, 64-bit fingerprint and SHA-256 of every normalised text, written once;
* a directory of 2^depth slots by fingerprint prefix that point to buckets. It starts with one
  bucket; a bucket with more distinct fingerprints than its capacity is split in two by its next
  bit, for as long as one is overfull, and the directory doubles when that bit is beyond its
  depth. It doubles up to 2^SLOT_BITS slots (more if there are that many buckets); a bucket below that
  has an entry of its own with its depth, so keys that share many bits cost one entry each and
  not a doubling. Copies are one key, so a hot key never overfills a bucket;
* bucket files with an entry for every distinct text. Each owner task has whole buckets, that is
  whole key ranges. Entries of one fingerprint form a chain, one for each different byte string.

Bytes are compared only for fingerprints that more than one row has: those texts are grouped
by bucket, fingerprint and bytes, combined before the shuffle, so a key with a third of all rows
sends one row per task. Each row then goes through its slot to its bucket, and there to the
entry of its fingerprint and digest. Entries with more than 1 / HOT of all rows, of which there
are fewer than HOT, are broadcast for that, so hot keys don't meet in one task.

Rows without doc_id are copies like others, but never the one that stays, unless no copy has a
doc_id: then keep_id is null and all are kept. Rows with the same doc_id and text stay or go
together in exact_dedup(); survivors() leaves one of them. An empty table gives no rows. Columns
other than doc_id and text are not read, and survivors() hands them through.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Keys with copies that are broadcast (8 bytes each); beyond, the texts are shuffled to them.
BROADCAST_KEYS = 1_000_000
#: Slots of a directory that is broadcast (16 bytes each); a larger one is joined by a shuffle.
BROADCAST_SLOTS = 1_000_000
#: Bits of a directory that doubles although few buckets are that deep.
SLOT_BITS = 16
#: Entries that are broadcast have more than one row in HOT.
HOT = 10_000


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(norm) -> F.Column:
    return F.unhex(F.sha2(norm, 256))


def keyed(docs: DataFrame) -> DataFrame:
    text = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    return text.select("doc_id", "norm", F.xxhash64("norm").alias("fp"))


def prefix(depth: int) -> F.Column:
    return F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")


def split_round(keys: DataFrame, start: int, depth: int, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Leaves (p, d) down to depth bits, and the prefixes (p) of depth bits that are still overfull.

    keys: the fingerprints below prefixes of start bits that are overfull (all of them if start is 0).
    """
    fine = keys.groupBy(prefix(depth).alias("q")).agg(F.count("*").alias("n"))
    level = fine.withColumn("d", F.explode(F.sequence(F.lit(start), F.lit(depth))))
    nodes = level.groupBy("d", F.expr(f"shiftright(q, {depth} - d)").alias("p")).agg(F.sum("n").alias("n"))
    nodes = common.written(nodes, "splits")
    over = nodes.where(F.col("n") > capacity)
    above = over.select((F.col("d") + 1).alias("d"), F.col("p").alias("up"))
    fits = nodes.where(F.col("n") <= capacity).withColumn("up", F.shiftright("p", 1))
    leaves = fits.join(above, ["d", "up"], "left_semi").unionByName(fits.where("d = 0")).select("p", "d")
    return leaves, over.where(F.col("d") == depth).select("p")


def directory(keys: DataFrame, capacity: int, step: int = 8) -> tuple[int, DataFrame]:
    """Depth, and the slots (slot, bucket, d: the bits of slot, more than the depth for deeper buckets). Only numbers of keys and buckets reach the driver.

    A bucket's number is its prefix with a leading one bit. keys: fp, distinct.
    """
    total = keys.count()
    start, depth = 0, min(24, max(0, math.ceil(math.log2(max(total, 1) / capacity)))) + 3
    first = depth
    leaves, over = split_round(keys, start, depth, capacity)
    while depth < 62 and over.limit(1).count():
        below = keys.join(over, prefix(depth) == over.p, "left_semi")
        start, depth = depth, min(62, depth + step)
        more, over = split_round(below, start, depth, capacity)
        leaves = common.written(leaves.unionByName(more), "leaves")
    if depth == 62:  # keys that share all bits of a prefix this long lie in one bucket
        leaves = leaves.unionByName(over.select("p", F.lit(62).alias("d")))
    top = leaves.agg(F.max("d")).first()[0] or 0
    top = min(top, max(SLOT_BITS, first))
    bucket = F.expr("shiftleft(1L, d) + p").alias("bucket")
    slot = F.explode(F.expr(f"sequence(shiftleft(p, {top} - d), shiftleft(p + 1, {top} - d) - 1)")).alias("slot")
    wide = leaves.where(F.col("d") <= top).select(slot, bucket, F.lit(top).alias("d"))
    deep = leaves.where(F.col("d") > top).select(F.col("p").alias("slot"), bucket, "d")
    return top, common.written(wide.unionByName(deep), "directory")


def routed(rows: DataFrame, depth: int, slots: DataFrame) -> DataFrame:
    """rows (with fp) and the bucket that their slot of the directory, or else the entry of a deeper bucket, points to."""
    if "d" not in slots.columns:
        slots = slots.withColumn("d", F.lit(depth))
    depths = sorted(r.d for r in slots.select("d").distinct().collect())  # at most 62 numbers
    sent = (lambda df: F.broadcast(df)) if depth <= math.log2(BROADCAST_SLOTS) and slots.where(F.col("d") != depth).limit(BROADCAST_SLOTS + 1).count() <= BROADCAST_SLOTS else (lambda df: df)
    if depths in ([], [depth]):
        return rows.withColumn("slot", prefix(depth)).join(sent(slots.drop("d")), "slot").drop("slot")
    for d in depths:
        own = slots.where(F.col("d") == d).select("slot", F.col("bucket").alias(f"bucket{d}"))
        rows = rows.withColumn("slot", prefix(d)).join(sent(own), "slot", "left").drop("slot")
    found = F.coalesce(*(f"bucket{d}" for d in depths))
    return rows.withColumn("bucket", found).drop(*(f"bucket{d}" for d in depths)).where("bucket is not null")


def build_index(docs: DataFrame, capacity: int = 4096) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """postings, entries, and the directory's depth and slots, all on shared files.

    Entries: bucket, fp, place in the chain, sha, keep_id, group_size.
    """
    spark = docs.sparkSession
    postings = common.written(keyed(docs).select("doc_id", "fp", digest("norm").alias("sha")), "postings")
    keys = common.written(postings.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("keep_id"), F.min("sha").alias("sha")), "keys")
    depth, slots = directory(keys.select("fp"), capacity)
    shared = keys.where("n > 1").select("fp")
    n = shared.count()
    texts = keyed(docs).join(F.broadcast(shared) if n <= BROADCAST_KEYS else shared, "fp", "left_semi")
    same = routed(texts, depth, slots).groupBy("bucket", "fp", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    chain = F.row_number().over(W.partitionBy("bucket", "fp").orderBy("keep_id", "sha"))
    chained = same.select("bucket", "fp", digest("norm").alias("sha"), "keep_id", "group_size").withColumn("place", chain)
    alone = routed(keys.where("n = 1"), depth, slots).select("bucket", "fp", "sha", "keep_id", F.col("n").alias("group_size"), F.lit(1).alias("place"))
    owned = chained.unionByName(alone).repartition(common.partitions(spark), "bucket").sortWithinPartitions("bucket", "fp", "place")
    return postings, common.written(owned, "entries"), depth, slots


def probed(postings: DataFrame, entries: DataFrame, depth: int, slots: DataFrame) -> DataFrame:
    """postings with keep_id and group_size of their entries, found through directory, bucket and chain."""
    key, total = ["bucket", "fp", "sha"], postings.count()
    found = entries.select(*key, "keep_id", "group_size")
    hot = F.col("group_size") * HOT > total
    rows = routed(postings, depth, slots)
    near = rows.join(F.broadcast(found.where(hot)), key, "left")
    rest = near.where("group_size is null").drop("keep_id", "group_size").join(found.where(~hot), key)
    return near.where("group_size is not null").unionByName(rest)


def exact_dedup(docs: DataFrame, capacity: int = 4096) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = probed(*build_index(docs, capacity))
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one of each text."""
    rows = common.written(exact_dedup(docs).select("doc_id", F.unhex("text_sha256").alias("digest"), "kept"), "decided")
    return common.without(docs, rows, digest(normalised(F.col("text"))))


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
