"""Blocks of documents, a table of distinct words, and facts about words joined back by position.

A block is a run of documents of about 8 MB of one input split. The blocks of a split
share one table of distinct words, a span, which ends early only where it would outgrow memory
(`CUT`). A span's words are dealt into hash buckets; one compressed row per
span and bucket goes to the bucket's task, which works out the facts of each distinct word once
and answers with one compressed row per span. The span's task puts the answers, in bucket order,
before the word numbers of its blocks. So the shuffles carry packed words and facts, not a row per
word, a word in every document costs an entry per span only, and besides a row per block there are
as many rows as a shuffle of splits to buckets has parts.

The documents are read twice, or once where the coded blocks are kept beside the words
(`coded_rows`). Both passes see the same blocks and spans, as the splits of a scan do not
change; a span whose words differ from those that were answered, by a digest per bucket, is an error.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of text of a block; distinct words, and bytes of them, at which a span ends.
CUT = (8 << 20, 1 << 21, 64 << 20)
HEAD = -1  # the place of a span's own row, before those of its buckets and blocks


def packed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays (one-dimensional) and bytes as one compressed string. Of an array, first the first bytes of all items, and so on."""
    import zstandard

    parts, heads = [], []
    for a in arrays:
        raw = a if isinstance(a, bytes) else np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        heads.append(f"{'' if isinstance(a, bytes) else a.dtype.str},{len(raw)}")
        parts.append(raw)
    head = ";".join(heads).encode()
    return zstandard.ZstdCompressor(1).compress(b"".join([len(head).to_bytes(4, "little"), head, *parts]))


def unpacked(data) -> list:
    import zstandard

    raw = memoryview(zstandard.ZstdDecompressor().decompress(data))
    at, out = 4 + int.from_bytes(raw[:4], "little"), []
    for head in bytes(raw[4:at]).decode().split(";"):
        kind, size = head.split(",")
        own = raw[at : at + int(size)]
        width = np.dtype(kind).itemsize if kind else 1
        out.append(np.ascontiguousarray(np.frombuffer(own, np.uint8).reshape(width, -1).T).view(kind).reshape(-1) if kind else bytes(own))
        at += int(size)
    return out


def smallest(a: np.ndarray) -> np.ndarray:
    """Unsigned integers in as few bytes as their largest needs."""
    most = int(a.max()) if len(a) else 0
    return a.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size] one after the other."""
    ends = np.cumsum(sizes)
    kind = np.int32 if max(len(flat), int(ends[-1]) if len(ends) else 0) < 1 << 31 else np.int64
    return flat.take(np.repeat((starts - (ends - sizes)).astype(kind), sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=kind))


def runs_at(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the runs of these sizes that flat is made of, those numbered `at`, one after the other."""
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    ends *= flat.itemsize
    runs = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))]).take(pa.array(at))
    data = runs.buffers()[2]
    return np.frombuffer(data, flat.dtype) if data is not None else flat[:0]


def buckets_of(docs: DataFrame) -> int:
    """Twice the shuffle partitions, so that hashed buckets spread evenly and grow in number with them."""
    return 2 * common.partitions(docs.sparkSession)


class Span:
    """The distinct words of some blocks, numbered as they come."""

    def __init__(self, key: int):
        self.key, self.words, self.size = key, defaultdict(itertools.count().__next__), 0

    def numbered(self, words: list[bytes]) -> np.ndarray:
        known = len(self.words)
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        self.size += sum(map(len, itertools.compress(words, (at >= known).tolist())))
        return at

    def full(self, words: int, size: int) -> bool:
        return len(self.words) >= words or self.size >= size

    def dealt(self, buckets: int):
        """The numbers of the words in bucket order, and (bucket, first, end, lengths, bytes) of each bucket's run of them."""
        import xxhash

        words = list(self.words)
        bucket = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(buckets)
        order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint64), kind="stable")
        bucket = bucket[order].astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(words)]]).tolist() if words else [0]
        runs = []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = runs_at(np.frombuffer(b"".join(words), np.uint8), lengths, order).tobytes()
        lengths = lengths[order]
        ends = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            runs.append((int(bucket[a]), a, b, lengths[a:b], data[ends[a] : ends[b]]))
        return order, runs


def each_block(batches, split, cut):
    """Yields (span, doc_ids, word numbers, offsets) of each block, and (span, None, None, None) behind the last of a span."""
    span, spans, task = None, 0, TaskContext.get().partitionId()
    for batch in batches:
        for at, to in common.slices(batch.column("text"), cut[0]):
            words, where, offsets = split(batch.column("text")[at:to])
            if span is None:
                span, spans = Span(task << 32 | spans), spans + 1
            yield span, batch.column("doc_id")[at:to], span.numbered(words)[where], offsets
            if span.full(*cut[1:]):
                yield span, None, None, None
                span = None
    if span is not None:
        yield span, None, None, None


def digest(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


def coded_rows(docs: DataFrame, split, counted=None, cut=CUT, blocks: bool = True, words: bool = True) -> DataFrame:
    """bucket, span, words, place, fact: rows of `bucket_rows` (place and fact null) and of blocks for `joined_back` (bucket and words null), from one pass."""
    buckets = buckets_of(docs)
    schema = pa.schema([("bucket", pa.int32()), ("span", pa.int64()), ("words", pa.binary()), ("place", pa.int32()), ("fact", pa.binary())])

    def rows(*own):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own), schema.types)], schema=schema)

    def run(batches):
        n, made = np.zeros(0, np.int64), 0
        for span, ids, at, offsets in each_block(batches, split, cut):
            if ids is not None:
                docs = ids.to_pylist()
                if words:
                    use = np.repeat(np.array([counted is not None and counted(d) for d in docs], bool), np.diff(offsets))
                    now = np.bincount(at[use], minlength=len(span.words))
                    now[: len(n)] += n
                    n = now
                if blocks:
                    valid, numbers = np.array([d is not None for d in docs], np.uint8), np.array([d or 0 for d in docs], "<i8")
                    yield rows((None, span.key, None, buckets + made, packed(offsets.astype("<i8"), smallest(at), numbers, valid)))
                    made += 1
                continue
            order, runs = span.dealt(buckets)
            if blocks:
                head = packed(smallest(order), np.array([r[0] for r in runs], "<i8"), np.array([digest(r[-1]) for r in runs], "<u8"))
                yield rows((None, span.key, None, HEAD, head))
            if words and runs:
                yield rows(*((bucket, span.key, packed(smallest(lengths), data, smallest(n[order[a:b]])), None, None) for bucket, a, b, lengths, data in runs))
            n = np.zeros(0, np.int64)

    return common.texts(docs).mapInArrow(run, "bucket int, span long, words binary, place int, fact binary")


def bucket_rows(docs: DataFrame, split, counted=None, cut=CUT) -> DataFrame:
    """bucket, span, words: the packed distinct words of each span and bucket, and how often documents with counted(doc_id) have them."""
    return words_of(coded_rows(docs, split, counted, cut, blocks=False))


def words_of(coded: DataFrame) -> DataFrame:
    """The rows of `bucket_rows` among those of `coded_rows`."""
    return coded.where("bucket is not null").select("bucket", "span", "words")


def answered(rows: DataFrame, facts, total=None) -> DataFrame:
    """span, place, fact: facts(distinct words, their counts) of each bucket (the place) dealt back to its spans.

    facts gives (arrays with one value per word, flat values, run lengths); a span gets these of
    its words, behind their digest. total(arrays, flat, lengths, counts) may give the bytes of one
    more row (span -1) per bucket.
    """

    def close(bucket, spans, parts):
        lengths, texts, counts = (list(x) for x in zip(*(unpacked(p) for p in parts)))
        sizes = np.array([len(x) for x in lengths])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([x.astype(np.int64) for x in lengths]))])
        words = pa.BinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype("<i8").tobytes()), pa.py_buffer(b"".join(texts))])
        coded = pc.dictionary_encode(words)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        own = common.byte_strings(coded.dictionary)
        n = np.bincount(code, np.concatenate([x.astype(np.float64) for x in counts]), len(own)).astype(np.int64)
        values, flat, runs = facts(own, n)
        out, at = [], 0
        for span, size, text in zip(spans, sizes.tolist(), texts):
            c = code[at : at + size]
            out.append((span, bucket, packed(np.array([digest(text)], "<u8"), *(smallest(v[c]) for v in values), smallest(runs[c]), smallest(runs_at(flat, runs, c)))))
            at += size
        if total is not None:
            out.append((-1, bucket, total(values, flat, runs, n)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))], ["span", "place", "fact"])

    def run(batches):
        now, spans, parts = None, [], []
        for batch in batches:
            for bucket, span, words in zip(*(batch.column(c).to_pylist() for c in ("bucket", "span", "words"))):
                if bucket != now and parts:
                    yield close(now, spans, parts)
                    spans, parts = [], []
                now = bucket
                spans.append(span)
                parts.append(words)
        if parts:
            yield close(now, spans, parts)

    dealt = rows.repartition(common.partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket", "span")
    return dealt.mapInArrow(run, "span long, place int, fact binary")


def joined_back(docs: DataFrame, split, answers: DataFrame, finish, schema: str, cut=CUT) -> DataFrame:
    """As `joined`, with the blocks coded by another pass over docs."""
    return joined(coded_rows(docs, split, cut=cut, words=False), answers, finish, schema)


def joined(coded: DataFrame, answers: DataFrame, finish, schema: str) -> DataFrame:
    """The batch of rows that finish(block, doc_ids, facts, word numbers, offsets) gives for each block.

    facts: the arrays that `answered` packed, of all the span's words, which the word numbers point
    into; none if the span has no words. coded: see `coded_rows`; answers: span, place, fact.
    """
    buckets = buckets_of(coded)

    def opened(head, parts):
        """Where the facts of each word number are, and the facts; parts: bucket, fact."""
        order, own, digests = unpacked(head)
        answers = [unpacked(p) for _, p in parts]
        if [b for b, _ in parts] != own.tolist() or [int(a[0][0]) for a in answers] != digests.tolist():
            raise ValueError("a span changed between two reads of the input")
        at = np.empty(len(order), np.int64)
        at[order.astype(np.int64)] = np.arange(len(order))
        return at, [np.concatenate(x) for x in zip(*(a[1:] for a in answers))]

    def gather(batches):
        head, parts, known = None, [], None
        for batch in batches:
            for span, place, fact in zip(*(batch.column(c).to_pylist() for c in ("span", "place", "fact"))):
                if place == HEAD:
                    head, parts, known = fact, [], None
                elif place < buckets:
                    parts.append((place, fact))
                else:
                    known = known or opened(head, parts)
                    offsets, at, numbers, valid = unpacked(fact)
                    ids = [d if v else None for d, v in zip(numbers.tolist(), valid.tolist())]
                    yield finish(span >> 32 << 32 | place - buckets, ids, known[1], known[0][at.astype(np.int64)], offsets)

    rows = coded.where("place is not null").select("span", "place", "fact").unionByName(answers.select("span", "place", "fact"))
    n = common.partitions(coded.sparkSession)
    # splits are numbered from 0, so each task gets as many as any other
    even = F.pmod(F.shiftright("span", 32) + F.col("span").bitwiseAND(0xFFFFFFFF), F.lit(n)).cast("int")
    return rows.repartitionById(n, even).sortWithinPartitions("span", "place").mapInArrow(gather, schema)
