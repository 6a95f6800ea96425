"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text (each counted once): its words, pairs of neighbouring words and pairs with
one word between, hashed to 2^bits places. Words are lower-cased A-Z, without ASCII marks at
their ends. The learner has a rate per coordinate and L1 sparsity, so few weights are left;
they have at most 2^bits entries and are broadcast.

It learns from at most `sample` labelled documents, those of the least hashes of doc_id; all
else covers all documents. Null or empty text gets the score of the intercept. Of several
labels of one doc_id the largest counts, null labels none; without labels all scores are 0.
Rows with the same doc_id are scored apart, as are rows without. Columns other than doc_id and text
are not read; survivors() hands all columns through and drops each row by its own text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .near_dedup import mix
from .tokens import _MARKS

MARKS = _MARKS + b"'"


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of every feature of some texts, repeats included."""
    import xxhash

    words, at, offsets = common.word_codes(texts)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w.strip(MARKS)) for w in words), np.uint64, len(words))
    codes = hashed[at] if len(words) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    docs, places, shift = [doc], [mix(codes)], np.uint64(64 - bits)
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        docs.append(doc[gap:][same])
        places.append(mix(codes[:-gap] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(gap) + (codes[gap:] >> np.uint64(1)))[same])
    return np.concatenate(docs), (np.concatenate(places) >> shift).astype(np.int64)


class Ftrl:
    """FTRL-proximal with one feature value, 1. The last place is the intercept, which has no L1."""

    def __init__(self, size: int, alpha=0.3, beta=1.0, l1=4.0, l2=0.0):
        self.z, self.n, self.size = np.zeros(size + 1), np.zeros(size + 1), size
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.size, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, places: np.ndarray, label: int) -> None:
        at = np.append(places, self.size)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, bits: int = 20, sample: int = 16_000, passes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that aren't 0, from labels (doc_id, toxic). One task learns from the bounded sample."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = common.texts(docs).join(F.broadcast(chosen), "doc_id").repartition(1).sortWithinPartitions(F.xxhash64("doc_id", "text"))

    def train(batches):
        model, cases = Ftrl(1 << bits), []
        for batch in batches:
            for at, to in common.slices(batch.column("text"), 1 << 20):
                doc, place = features(batch.column("text")[at:to], bits)
                order = np.argsort(doc, kind="stable")
                ends = np.searchsorted(doc[order], np.arange(to - at + 1))
                for i, label in enumerate(batch.column("toxic")[at:to].to_pylist()):
                    cases.append((np.unique(place[order[ends[i] : ends[i + 1]]]).astype(np.int32), label))
        for _ in range(passes):
            for places, label in cases:
                model.learn(places.astype(np.int64), label)
        w = model.weights(np.arange(model.size + 1)).astype(np.float32)
        if cases:
            w[-1] = w[-1] or 1e-6
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"at": [at.astype("<i8").tobytes()], "w": [w[at].astype("<f4").tobytes()]})

    found = rows.mapInArrow(train, "at binary, w binary").first()
    if found is None:
        return np.zeros(0, "<i8"), np.zeros(0, "<f4")
    return np.frombuffer(bytes(found.at), "<i8"), np.frombuffer(bytes(found.w), "<f4")


def scorer(spark, model: tuple[np.ndarray, np.ndarray], bits: int):
    """A function of a string array that gives (from, to, scores) in turn."""
    sent = spark.sparkContext.broadcast(model)

    def apply(texts):
        at, w = sent.value
        dense = np.zeros((1 << bits) + 1, np.float32)
        dense[at] = w
        for a, b in common.slices(texts, 1 << 20):
            doc, place = features(texts[a:b], bits)
            hit = dense[place] != 0
            pairs = np.unique(doc[hit] * (1 << bits) + place[hit])
            total = dense[-1] + np.bincount(pairs >> bits, dense[pairs & ((1 << bits) - 1)].astype(float), b - a)
            yield a, b, 1 / (1 + np.exp(-np.clip(total, -35, 35))) if len(at) else np.zeros(b - a)

    return apply


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = 20) -> DataFrame:
    """doc_id and score of every row."""
    of = scorer(docs.sparkSession, model, bits)

    def apply(batches):
        for batch in batches:
            for a, b, value in of(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(value)], ["doc_id", "score"])

    return common.texts(docs).mapInArrow(apply, "doc_id long, score double")


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; learns only from rows that aren't held out."""
    out = score(docs, fit(docs, labels.where(~held_out())))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def survivors(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bits: int = 20) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns. Each row goes by its own text."""
    of = scorer(docs.sparkSession, fit(docs, labels.where(~held_out()), bits), bits)

    def keep(batches):
        for batch in batches:
            for a, b, value in of(batch.column("text")):
                yield batch.slice(a, b - a).filter(pa.array(value < threshold))

    return docs.mapInArrow(keep, docs.schema)


def op6_toxicity(spark, sf_dir):
    return classified(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
