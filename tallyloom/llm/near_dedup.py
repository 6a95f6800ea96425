"""MinHash near-dedup: fast similarity sketching, banding, exact verification on full sets.

A document's set holds the hashes of its distinct 5-word shingles (words lower-cased A-Z); a
shorter text is one shingle as a whole; a text without words has an empty set and links with
nothing. Equal sets form one class, which is then one node, so copies are never paired.

Sketch: in round i every element falls into a bin (in the second half of the rounds, bin
i - bins is chosen for all), and a bin keeps the least value of the first round that reached
it; rounds go on while a bin is empty, so every coordinate is filled, most often in one or two
rounds. Bands of 4 coordinates are the buckets.

Candidates never leave a task as pairs of a bucket. Every member of a bucket is first compared
with one leader; confirmed links join components. Buckets of three and more members that then
still lie in several components are compared in blocks of bounded size and bytes: a block (or a
pair of blocks of one bucket) counts the shared shingles of all its members on their full sets
and gives out a spanning forest of the links it confirms, at most one row per member. The rule
is the same for buckets of any size, and nothing is capped, sampled or estimated; only pairs
that share no band are lost. Buckets with the same members are one bucket.

A null text is empty. Rows without doc_id stand for no one: their group's component_id is the
least doc_id that it has, else null, and then all of them are kept. Repeated rows are rows of one
node; with the least doc_id of a group repeated, all rows of that doc_id in the group count as
kept (survivors() leaves one row of each doc_id and text). Columns other than doc_id and text
are not read, and survivors() hands them through. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from . import common

#: Nodes whose text digests may be broadcast (32 bytes each) to pick their texts; beyond, texts are shuffled.
BROADCAST_NODES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words_each: int = 5):
    """Sorted distinct shingle hashes of every text, end to end, and where each text's begin and end."""
    import xxhash

    words, at, offsets = common.word_codes(texts)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[at] if words else np.zeros(0, np.uint64)
    lengths = np.diff(offsets)
    k, odd = words_each, np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(max(len(codes) - k + 1, 0), np.uint64)
    for i in range(k):
        rolled = mix(rolled * odd + codes[i : i + len(rolled)])
    counts = np.where(lengths >= k, lengths - k + 1, (lengths > 0).astype(np.int64))
    out, ends = [], np.zeros(len(lengths) + 1, np.int64)
    for d in range(len(lengths)):
        if lengths[d] >= k:
            own = np.sort(rolled[offsets[d] : offsets[d] + counts[d]])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif lengths[d]:
            h = np.full(1, lengths[d], np.uint64)
            for c in codes[offsets[d] : offsets[d + 1]]:
                h = mix(h * odd + c + np.uint64(1))
            own = h
        else:
            own = rolled[:0]
        out.append(own)
        ends[d + 1] = ends[d] + len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), ends


def sketches(values: np.ndarray, ends: np.ndarray, bins: int) -> np.ndarray:
    """One row of bins values (round and hash) for each set; empty sets keep the largest value."""
    counts = np.diff(ends)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(counts), bins), none, np.uint64)
    flat, bits = out.reshape(-1), np.uint64(64 - bins.bit_length() + 1)
    live = np.flatnonzero(counts)
    for i in range(2 * bins):
        if not len(live):
            break
        sizes = counts[live]
        row = np.repeat(live, sizes)
        first = np.cumsum(sizes) - sizes
        x = values[np.repeat(ends[live] - first, sizes) + np.arange(sizes.sum())]
        h = mix(x + np.uint64((i + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        bin_of = (h >> bits).astype(np.int64) if i < bins else np.full(len(h), i - bins)
        value = (np.uint64(i) << np.uint64(52)) | (h & np.uint64((1 << 52) - 1))
        slot = row * bins + bin_of
        np.minimum.at(flat, slot, value)  # later rounds have larger values: filled bins stay
        live = live[(out[live] == none).any(1)]
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    n, bins = sketch.shape
    parts = sketch.reshape(n, bins // rows, rows)
    keys = np.zeros((n, bins // rows), np.uint64) + np.arange(bins // rows, dtype=np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return keys.view(np.int64)


def digests(values: np.ndarray, ends: np.ndarray) -> list[int | None]:
    """A 64-bit name of every set that isn't empty."""
    raw = memoryview(values.tobytes())
    return [int.from_bytes(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=8).digest(), "little", signed=True) if b > a else None for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def signatures(docs: DataFrame, bins: int, rows: int) -> DataFrame:
    """doc_id, digest (of the text), node, n_shingles, bands (none for an empty set)."""

    def sign(batches):
        for batch in batches:
            for at, to in common.slices(batch.column("text"), 2 << 20):
                values, ends = shingle_sets(batch.column("text")[at:to])
                keys = band_keys(sketches(values, ends, bins), rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[at:to], batch.column("digest")[at:to], pa.array(digests(values, ends), pa.int64()), pa.array(np.diff(ends)), lists], ["doc_id", "digest", "node", "n_shingles", "bands"])

    keyed = common.texts(docs).select("doc_id", common.text_digest("text").alias("digest"), "text")
    return keyed.mapInArrow(sign, "doc_id long, digest binary, node long, n_shingles long, bands array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, elements (sorted 64-bit hashes) of the wanted nodes; nodes: node and the digest of a text that has its set."""

    def gather(batches):
        for batch in batches:
            for at, to in common.slices(batch.column("text"), 2 << 20):
                values, ends = shingle_sets(batch.column("text")[at:to])
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((8 * ends).tobytes()), pa.py_buffer(values.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(digests(values, ends), pa.int64()), raw.cast(pa.binary())], ["node", "elements"])

    ids = nodes.join(wanted, "node", "left_semi").select("digest").distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_NODES else ids
    keyed = common.texts(docs).select(common.text_digest("text").alias("digest"), "text")
    sets = keyed.join(ids, "digest", "left_semi").select("text").mapInArrow(gather, "node long, elements binary")
    return common.written(sets.dropDuplicates(["node"]), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with their Jaccard similarity as shared and united counts, from full sets."""

    def compare(batches):
        for batch in batches:
            shared, united = [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(p) + len(q) - len(np.union1d(p, q))
                shared.append(both)
                united.append(len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(united, pa.int64())], ["a", "b", "shared", "united"])

    side = lambda node, as_: sets.select(F.col("node").alias(node), F.col("elements").alias(as_))
    joined = pairs.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b")
    return common.written(joined.mapInArrow(compare, "a long, b long, shared long, united long"), "confirmed")


def spanning_links(node, label, sizes, sets, left, right, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between members left and right (places) of different labels, from full sets.

    A member's shared counts with all of right come from the places that its elements have there.
    """
    kinds, own = np.unique(label, return_inverse=True)
    parent, apart, out = list(range(len(kinds))), len(kinds), []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    values = np.concatenate([sets[j] for j in right])
    holder = np.repeat(np.arange(len(right)), sizes[right])
    order = np.argsort(values, kind="stable")
    values, holder = values[order], holder[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]])
    starts = np.append(np.flatnonzero(fresh), len(values))
    values = values[fresh]
    for i in left:
        if apart == 1:
            break
        at = np.minimum(np.searchsorted(values, sets[i]), len(values) - 1)
        at = at[values[at] == sets[i]]
        counts = starts[at + 1] - starts[at]
        places = np.repeat(starts[at] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        shared = np.bincount(holder[places], minlength=len(right))
        for j in right[np.flatnonzero(shared * 100 >= percent * (sizes[i] + sizes[right] - shared))].tolist():
            a, b = root(own[i]), root(own[j])
            if a != b:
                parent[a], apart = b, apart - 1
                out.append((int(node[i]), int(node[j])))
    return out


def block_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links inside each bucket. members: key, blocks, node, label, elements.

    Each block of a bucket, and each pair of its blocks, is one group.
    """

    def close(parts):
        rows = pa.Table.from_batches(parts)
        lo, hi = rows["lo"][0].as_py(), rows["hi"][0].as_py()
        node, label, own = (rows[c].to_numpy() for c in ("node", "label", "own"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["elements"]]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        found = spanning_links(node, label, sizes, sets, np.flatnonzero(own == lo), np.flatnonzero(own == hi), percent)
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def compare(batches):
        parts, now = [], None
        for batch in batches:
            names = np.stack([batch.column(c).to_numpy() for c in ("key", "lo", "hi")])
            cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for at, to in zip(cuts[:-1], cuts[1:]):
                if to == at:
                    continue
                own = tuple(names[:, at].tolist())
                if own != now and parts:
                    yield close(parts)
                    parts = []
                now = own
                parts.append(batch.slice(at, to - at))
        if parts:
            yield close(parts)

    own = members.withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = own.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "node", "label", "elements")
    dealt = dealt.repartition(common.partitions(members.sparkSession), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    return dealt.mapInArrow(compare, "a long, b long")


def classes(docs: DataFrame, percent: int, bins: int, rows: int, block: int, block_bytes: int) -> DataFrame:
    """doc_id, digest, n_shingles, component_id of every row of docs."""
    signed = common.written(signatures(docs, bins, rows), "signatures")
    full = signed.where("node is not null")
    nodes = common.written(full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("digest").alias("digest"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "nodes")
    buckets = nodes.select("node", "n", F.explode("bands").alias("key"))
    signs = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"sign{i}") for i in (1, 2)]
    shared = buckets.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("leader"), F.sum("n").alias("elements"), *signs).where("members > 1")
    shared = shared.groupBy("members", "leader", "elements", "sign1", "sign2").agg(F.min("key").alias("key")).drop("sign1", "sign2")
    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("elements") * 8 / block_bytes)).alias("blocks")
    buckets = common.written(buckets.join(shared.select("key", "members", "leader", blocks), "key"), "buckets")
    sets = full_sets(docs, nodes.select("node", "digest"), buckets.select("node").distinct())

    sizes = nodes.select(F.col("node").alias("leader"), F.col("n").alias("m"))
    led = buckets.where("node <> leader").select("node", "n", "leader").distinct().join(sizes, "leader")
    led = led.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    links = confirmed(led, sets).where(F.col("shared") * 100 >= F.col("united") * percent).select("a", "b")
    labels = components(links, "a", "b").withColumnRenamed("component", "label")

    members = buckets.where("members > 2").select("key", "node", "blocks").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    members = common.written(members, "members")
    several = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    found = block_links(members.join(several, "key").join(sets, "node"), percent)
    labels = components(common.written(links.unionByName(found), "links"), "a", "b")

    roots = nodes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = roots.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = roots.join(least, "component").select("node", "component_id", F.lit(True).alias("in_group"))
    out = signed.drop("bands").join(of_node, "node", "left")
    return out.withColumn("component_id", F.when(F.col("in_group"), F.col("component_id")).otherwise(F.col("doc_id"))).drop("node", "in_group")


def near_groups(docs: DataFrame, percent: int = 75, bins: int = 128, rows: int = 4, block: int = 1024, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    out = classes(docs, percent, bins, rows, block, block_bytes)
    return out.select("doc_id", "n_shingles", "component_id", kept())


def kept():
    return (F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept")


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one document of each group, and one row of repeated ones."""
    rows = common.written(classes(docs, 75, 128, 4, 1024, 16 << 20).select("doc_id", "digest", kept()), "decided")
    return common.without(docs, rows, common.text_digest("text"))


def op7_near_dedup(spark, sf_dir):
    return near_groups(common.table(spark, sf_dir, "documents"))
