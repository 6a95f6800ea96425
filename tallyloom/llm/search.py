"""Ranked lexical search over a two-level quantised index.

The score of a document for an item sums w * impact over the item's terms, where
impact = (10^9 * tf) div (1000 * tf + 20 * m) is below 10^6, and all arithmetic is exact.

Index: a block is a run of whole documents of about `at_once` bytes; its row has the distinct terms
with their numbers of documents, and of every term's documents (a) the place in the block and the
impact, rounded up to a byte (level one), (b) the occurrences (level two). Blocks are written to
the shared folder, all documents and all terms of them; the levels are columns, so that a pass
reads only what it needs.

Search: a first pass over level one adds w * byte * STEP to an upper bound of each document's score
and w * ((byte - 1) * STEP + 1) to a lower bound; the k largest lower bounds of each item leave a task,
and the k-th largest of all is the item's floor. The second pass rescores every document whose upper
bound reaches the floor from level two with the integer formula, and the k best of each item and
task are merged. Documents with equal scores rank by doc_id, so a large group of copies that ties
with the floor is rescored as a whole in the tasks that hold it, but sends k rows per task.

Weights of the items' terms are broadcast; items are searched in groups of at most about `terms_at_once`
(item, term) pairs, so the broadcast has a bound however many items there are.

Null text has no terms, as a document and as an item. Rows of one item_id are one item with the
terms of all of them; null item_ids are one item. Every row of docs is a document, repeated ones
too; without doc_id it ranks last among equal scores. Columns other than doc_id, text and item_id
are not read. An empty table on either side gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .word_table import packed, smallest, unpacked

#: Width of a level-one byte; 255 of them reach the largest impact.
STEP = 3922
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX = "head binary, terms binary, coarse binary, exact binary"


def sizes(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all their terms with repeats."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TERM)).cast("long").alias("n")
    row = docs.select(n).agg(F.count_if(F.col("n") > 0).alias("d"), F.sum("n").alias("t")).first()
    return row.d, row.t or 0


def build_index(docs: DataFrame, documents: int, terms: int, at_once: int = 8 << 20) -> DataFrame:
    """One row per block: packed doc_ids and lengths, terms, level one, level two."""
    table = common.term_table(digits=True)

    def index(batches):
        for batch in batches:
            for a, b in common.slices(batch.column("text"), at_once):
                words, at, offsets = common.word_codes(common.translated(batch.column("text")[a:b], table))
                if not words:
                    continue
                order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
                place = np.empty(len(words), np.int64)
                place[order] = np.arange(len(words))
                words = [words[i] for i in order]
                n = np.diff(offsets)
                key, tf = np.unique(place[at] * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
                term, doc = key // len(n), key % len(n)
                byte = -(-impact(tf, length(n, documents, terms)[doc]) // STEP)
                ids = batch.column("doc_id")[a:b]
                head = packed(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), smallest(n))
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                runs = np.bincount(term, minlength=len(words))
                first = np.concatenate([[True], term[1:] != term[:-1]])
                steps = np.where(first, doc, doc - np.concatenate([[0], doc[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (head, packed(smallest(lengths), b"".join(words), smallest(runs)), packed(smallest(steps), byte.astype(np.uint8)), packed(smallest(tf)))], ["head", "terms", "coarse", "exact"])

    return common.written(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(index, INDEX), "index")


def length(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    return 50 + (50 * n.astype(np.int64) * documents) // max(terms, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(found).alias("term")).distinct()


class Terms:
    """A block's terms that are looked for: (place in looked-for, first posting, number of postings)."""

    def __init__(self, data: bytes, wanted: pa.Array):
        lengths, text, runs = unpacked(data)
        ends = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.astype("<i8").tobytes()), pa.py_buffer(text)])
        at = pc.index_in(wanted, value_set=words.cast(pa.binary()))
        self.which = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy(zero_copy_only=False)[self.which]
        starts = np.cumsum(runs.astype(np.int64)) - runs
        self.starts, self.sizes = starts[at], runs.astype(np.int64)[at]


def frequencies(index: DataFrame, terms: DataFrame) -> DataFrame:
    """term, df: the number of documents of each of the terms (a bounded group of them)."""
    wanted = index.sparkSession.sparkContext.broadcast([r.term.encode() for r in terms.select("term").distinct().collect()])

    def count(batches):
        own, df = pa.array(wanted.value, pa.binary()), np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for data in batch.column("terms"):
                found = Terms(data.as_py(), own)
                df[found.which] += found.sizes
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([own.cast(pa.string()).take(pa.array(at)), pa.array(df[at])], ["term", "df"])

    return index.select("terms").mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Query:
    """A bounded group of items: their terms, and of each item the places of its terms with their weights."""

    def __init__(self, rows, documents: int):
        self.terms = sorted({r.term for r in rows})
        place = {t: i for i, t in enumerate(self.terms)}
        own = {}
        for r in rows:
            own.setdefault(r.item_id, []).append((place[r.term], math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1)))))
        self.items = [(k, *(np.array(x, np.int64) for x in zip(*sorted(v)))) for k, v in own.items()]
        self.floors = {}


def blocks(batches, query: Query):
    """Yields (block's columns, its found terms, which posting belongs to which document, bytes) of level one."""
    wanted = pa.array([t.encode() for t in query.terms], pa.binary())
    for batch in batches:
        for i in range(batch.num_rows):
            own = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            found = Terms(own["terms"], wanted)
            if len(found.which):
                steps, byte = unpacked(own["coarse"])
                yield own, found, steps, byte


def bounds(found: Terms, docs: dict, byte: np.ndarray, places: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bound of every document's score for one item, as whole numbers."""
    upper, lower = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.searchsorted(found.which, places)
    at = np.minimum(at, len(found.which) - 1)
    for k, w in zip(at[found.which[at] == places].tolist(), weights[found.which[at] == places].tolist()):
        own = docs[k]
        value = byte[found.starts[k] : found.starts[k] + found.sizes[k]].astype(np.int64) * (w * STEP)
        upper[own] += value  # a term has one posting per document
        lower[own] += value - w * (STEP - 1)
    return upper, lower


def postings(found: Terms, steps: np.ndarray) -> dict:
    """The documents of each found term, by its place among them."""
    return {k: np.cumsum(steps[a : a + n].astype(np.int64)) for k, (a, n) in enumerate(zip(found.starts.tolist(), found.sizes.tolist()))}


def floors(index: DataFrame, query: Query, k: int) -> dict:
    """The k-th largest lower bound of each item; items with fewer documents have none."""
    sent = index.sparkSession.sparkContext.broadcast(query)

    def best(batches):
        top = {}
        for own, found, steps, byte in blocks(batches, sent.value):
            n, docs = len(unpacked(own["head"])[1]), postings(found, steps)
            for i, (_, places, weights) in enumerate(sent.value.items):
                lower = bounds(found, docs, byte, places, weights, n)[1]
                lower = np.concatenate([top.get(i, lower[:0]), lower[lower > 0]])
                top[i] = np.partition(lower, len(lower) - k)[len(lower) - k :] if len(lower) > k else lower
        for i, values in top.items():
            if len(values):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i), pa.int32()), pa.array(values)], ["item", "lower"])

    rows = index.select("head", "terms", "coarse").mapInArrow(best, "item int, lower long")
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("lower")))
    found = rows.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k)
    return {query.items[r.item][0]: r.lower for r in found.collect()}


def rescored(index: DataFrame, query: Query, documents: int, terms: int, k: int) -> DataFrame:
    """item_id, doc_id, score: the k best of each task among the documents whose upper bound reaches the item's floor."""
    sent = index.sparkSession.sparkContext.broadcast(query)
    none = (1 << 63) - 1

    def score(batches):
        best = {}
        for own, found, steps, byte in blocks(batches, sent.value):
            ids, valid, n = unpacked(own["head"])
            ids, m = np.where(valid > 0, ids, none), length(n, documents, terms)
            docs, tf = postings(found, steps), None
            for i, (item, places, weights) in enumerate(sent.value.items):
                upper = bounds(found, docs, byte, places, weights, len(n))[0]
                near = upper >= max(sent.value.floors.get(item, 1), 1)
                if not near.any():
                    continue
                tf = unpacked(own["exact"])[0] if tf is None else tf
                total = np.zeros(len(n), np.int64)
                weight = dict(zip(places.tolist(), weights.tolist()))
                for j in np.flatnonzero(np.isin(found.which, places)).tolist():
                    hit = near[docs[j]]
                    d = docs[j][hit]
                    total[d] += weight[int(found.which[j])] * impact(tf[found.starts[j] : found.starts[j] + found.sizes[j]][hit], m[d])
                at = np.flatnonzero(near & (total > 0))
                rows = zip((-total[at]).tolist(), ids[at].tolist(), (valid[at] == 0).tolist())
                best[i] = heapq.nsmallest(k, [*best.get(i, ()), *rows])
        for i, rows in best.items():
            item = sent.value.items[i][0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(rows), pa.int64()), pa.array([None if gone else d for _, d, gone in rows], pa.int64()), pa.array([-s for s, *_ in rows], pa.int64())], ["item_id", "doc_id", "score"]
            )

    return index.mapInArrow(score, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, terms_at_once: int = 500_000) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    documents, terms = sizes(docs)
    index = build_index(docs, documents, terms)
    wanted = common.written(item_terms(items), "item_terms")
    pairs = wanted.count()
    groups = max(1, -(-2 * pairs // terms_at_once))  # by hash, so a group is well below the bound unless one item alone is above it
    found = []
    for g in range(groups):
        own = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g)
        query = Query(own.join(frequencies(index, own), "term").collect(), documents)
        if query.items:
            query.floors = floors(index, query, k)
            found.append(common.written(rescored(index, query, documents, terms, k), "scored"))
    rows = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for more in found:
        rows = rows.unionByName(more)
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_search(spark, sf_dir):
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + TERM + "')"
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
tf AS MATERIALIZED (SELECT i, doc_id, 50 + (50 * n0 * s.n) // s.l AS m, term, tf FROM (SELECT i, any_value(doc_id) AS doc_id, any_value(n0) AS n0, term, count(*) AS tf
  FROM (SELECT i, doc_id, len(terms) AS n0, unnest(terms) AS term FROM d) GROUP BY i, term), s),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT item_id, term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM q JOIN df USING (term), s),
f AS (SELECT item_id, i, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM w JOIN tf USING (term) GROUP BY item_id, i)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INT AS rank, doc_id, score FROM f WHERE score > 0) WHERE rank <= 50
"""
