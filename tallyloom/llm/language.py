"""Language ID by a byte convolutional network.

A text is its UTF-8 bytes with A-Z lowered, cut into windows of `WINDOW` bytes that overlap by the
widest filter less one, so every byte sequence that a filter can see lies in a window; the last window is
filled up with zeros. A window's bytes are embedded, filters of several widths run over them, each filter's
largest value is kept, and a softmax over the languages follows. A text's prediction is the
softmax of the mean of its windows' log-probabilities, each weighted by the bytes that the window adds.

The network is trained in numpy by Adam in one task, on a bounded sample: of the `classes` most
frequent languages the `docs_each` documents with the least hashes of doc_id, and of each document
at most PIECES pieces of WINDOW characters, evenly spread over the whole text. With 256 languages these are
at most 600,000 pieces; all else covers all documents and whole texts. The weights (a few thousand
numbers) are broadcast.

Null text and text without a letter are `und` with score 0. Rows are predicted apart, repeated
ones too. Rows without doc_id or lang, or with null text, teach nothing. Without any labelled text
every prediction is `und` with score 0. Columns other than doc_id, text and (to learn) lang are not
read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .word_table import packed, unpacked

WINDOW, PIECES = 256, 4
WIDTHS, FILTERS, WIDE = (2, 3, 4), 16, 8  # filter widths, filters of each, numbers a byte is embedded in
SPAN = max(WIDTHS)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


class Network:
    """Embedding of bytes, one matrix of all filters over SPAN bytes (narrow ones are 0 beyond their width), output."""

    def __init__(self, languages: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        self.mask = np.zeros((SPAN * WIDE, n), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[: w * WIDE, i * FILTERS : (i + 1) * FILTERS] = 1
        shapes = {"bytes": (256, WIDE), "filters": (SPAN * WIDE, n), "bias": (n,), "out": (n, languages), "base": (languages,)}
        scale = {"bytes": 0.5, "filters": 0.3, "bias": 0, "out": 0.1, "base": 0}
        self.p = {k: (rng.standard_normal(s) * scale[k]).astype(np.float32) for k, s in shapes.items()}
        self.p["filters"] *= self.mask
        self.p["bytes"][0] = 0  # what fills up the last window

    def convolved(self, windows: np.ndarray):
        """Embedded runs of SPAN bytes, and every filter's value at every place."""
        wide = np.concatenate([windows, np.zeros((len(windows), SPAN - 1), np.uint8)], axis=1)
        embedded = self.p["bytes"][wide]
        runs = np.lib.stride_tricks.sliding_window_view(embedded, SPAN, axis=1)  # window, place, number, byte
        runs = np.ascontiguousarray(runs.transpose(0, 1, 3, 2)).reshape(-1, SPAN * WIDE)
        return wide, runs, (runs @ self.p["filters"]).reshape(len(windows), windows.shape[1], -1)

    def pooled(self, values: np.ndarray) -> np.ndarray:
        return np.maximum(values.max(axis=1) + self.p["bias"], 0)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        x = self.pooled(self.convolved(windows)[2]) @ self.p["out"] + self.p["base"]
        x = x - x.max(axis=1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=1, keepdims=True))

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy."""
        n = len(windows)
        wide, runs, values = self.convolved(windows)
        at, hidden = values.argmax(axis=1), self.pooled(values)
        x = hidden @ self.p["out"] + self.p["base"]
        x = np.exp(x - x.max(axis=1, keepdims=True))
        off = x / x.sum(axis=1, keepdims=True)
        off[np.arange(n), labels] -= 1
        off /= n
        back = (off @ self.p["out"].T) * (hidden > 0)
        chosen = runs.reshape(n, windows.shape[1], -1)[np.arange(n)[:, None], at]  # window, filter, run
        to_runs = np.einsum("bf,rf->bfr", back, self.p["filters"]).reshape(-1, WIDE)
        of_bytes = np.zeros_like(self.p["bytes"])
        np.add.at(of_bytes, wide[np.arange(n)[:, None, None], at[:, :, None] + np.arange(SPAN)].reshape(-1), to_runs)
        of_bytes[0] = 0
        return {"bytes": of_bytes, "filters": np.einsum("bf,bfr->rf", back, chosen) * self.mask, "bias": back.sum(axis=0), "out": hidden.T @ off, "base": off.sum(axis=0)}


def trained(windows: np.ndarray, labels: np.ndarray, languages: int, steps: int = 1500, batch: int = 64, rate: float = 0.01, seed: int = 1) -> Network:
    """Adam over batches that hold every language alike; the rate falls to 0."""
    net, rng = Network(languages, seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    of = [np.flatnonzero(labels == k) for k in range(languages)]
    for step in range(1, steps + 1):
        which = rng.integers(languages, size=batch)
        chosen = np.array([of[k][rng.integers(len(of[k]))] for k in which])
        for k, g in net.gradients(windows[chosen], labels[chosen]).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.p[k] -= (rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def windows_of(texts: pa.Array):
    """Windows of all texts, the text each is of, and the bytes it adds; empty texts have none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(bytes(memoryview(data)[ends[0] : ends[-1]]).translate(LOWER) if data is not None else b"", np.uint8)
    ends = ends - ends[0]
    n, stride = np.diff(ends), WINDOW - SPAN + 1
    count = np.where(n > 0, np.maximum(-(-(n - SPAN + 1) // stride), 1), 0)
    of = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start, end = ends[:-1][of] + place * stride, ends[1:][of]
    padded = np.concatenate([flat, np.zeros(WINDOW, np.uint8)])
    added = np.minimum(end, start + WINDOW) - start - np.where(place > 0, SPAN - 1, 0)

    def cut(a, b):
        at = start[a:b, None] + np.arange(WINDOW)
        return np.where(at < end[a:b, None], padded[np.minimum(at, len(padded) - 1)], 0).astype(np.uint8)

    return cut, of, added


def fit(docs: DataFrame, classes: int = 256, docs_each: int = 600, steps: int = 1500) -> tuple[list[str], dict]:
    """Languages and weights, from the text and lang of docs."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null")
    common_ones = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(classes).select("lang")
    ids = rows.select("lang", "doc_id").join(F.broadcast(common_ones), "lang").distinct()
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = ids.withColumn("place", place).where(F.col("place") <= docs_each).drop("place")
    long = F.greatest(F.length("text") - WINDOW, F.lit(0))
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substr("text", F.floor(long * i / (PIECES - 1)).cast("int") + 1, F.lit(WINDOW))))
    of_rows = rows.join(F.broadcast(chosen), ["lang", "doc_id"]).select("lang", "doc_id", pieces.alias("pieces"))
    sample = of_rows.groupBy("lang", "doc_id").agg(F.min("pieces").alias("pieces")).repartition(1).sortWithinPartitions("lang", F.xxhash64("doc_id"), "doc_id")

    def train(batches):
        names, texts = [], []
        for batch in batches:
            for lang, own in zip(batch.column("lang").to_pylist(), batch.column("pieces").to_pylist()):
                own = [x for x in own if any(map(str.isalpha, x))]
                names += [lang] * len(own)
                texts += own
        if texts:
            cut, of, _ = windows_of(pa.array(texts))
            languages, label = np.unique(np.array(names, object), return_inverse=True)
            net = trained(cut(0, len(of)), label[of], len(languages), steps)
            yield pa.RecordBatch.from_pydict({"languages": [languages.tolist()], "shapes": [str({k: x.shape for k, x in net.p.items()})], "weights": [packed(*(x.astype("<f4").reshape(-1) for x in net.p.values()))]})

    found = sample.mapInArrow(train, "languages array<string>, shapes string, weights binary").first()
    if found is None:
        return [], {}
    import ast

    shapes = ast.literal_eval(found.shapes)
    return list(found.languages), {k: x.reshape(shapes[k]) for k, x in zip(shapes, unpacked(bytes(found.weights)))}


def predicted(docs: DataFrame, model: tuple[list[str], dict], at_once: int = 256) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        languages, weights = sent.value
        net = Network(max(len(languages), 1))
        net.p = weights
        for batch in batches:
            for a, b in common.slices(batch.column("text"), 4 << 20):
                total, size = np.zeros((b - a, max(len(languages), 1))), np.zeros(b - a)
                if languages:
                    cut, of, added = windows_of(batch.column("text")[a:b])
                    for i in range(0, len(of), at_once):
                        own, weight = of[i : i + at_once], added[i : i + at_once]
                        np.add.at(total, own, net.log_probabilities(cut(i, i + at_once)) * weight[:, None])
                        np.add.at(size, own, weight)
                mean = total / np.maximum(size, 1)[:, None]
                best = mean.argmax(axis=1)
                share = np.exp(mean - mean.max(axis=1, keepdims=True))
                known = batch.column("letters")[a:b].to_numpy(zero_copy_only=False) & (size > 0)
                score = np.where(known, 1 / share.sum(axis=1), 0.0)
                name = pc.if_else(pa.array(known), pa.array(languages or ["und"], pa.string()).take(pa.array(best)), "und")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], name, pa.array(score)], ["doc_id", "lang_pred", "score"])

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), text.rlike(r"\p{L}").alias("letters")).mapInArrow(apply, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns only from rows that aren't held out."""
    out = predicted(docs, fit(docs.where(~held_out())))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op12_language(spark, sf_dir):
    return language_id(common.table(spark, sf_dir, "documents"))
