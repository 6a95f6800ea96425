"""BPE encoding and decoding through a table of distinct words.

Texts are split into white-space separated words; each distinct word is encoded once, in the
task of its hash bucket; ids go back to the blocks of documents and are joined by position.
Decoding joins the distinct ids of each block to the pieces of the vocabulary by id (the
vocabulary's size is fixed, so it is broadcast), and puts the pieces in the ids' places.

Null text is empty: no ids, empty decoded text. Rows with the same doc_id, or none, are encoded
apart. Columns other than doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens, word_table

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Marks a block's own row among the rows of its distinct ids.
BLOCK = -1


def split(texts: pa.Array):
    """Distinct words, word numbers, offsets. A-Z are lowered, except in texts that may hold special tokens."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
    coded = pc.dictionary_encode(lists.flatten())
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return [w.encode() for w in coded.dictionary.to_pylist()], coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]


def ids_of_words(path: str):
    """A function of (words, counts) for word_table.answered: the ids of each word."""

    def facts(words, counts):
        encoder = tokens.encoder(path)
        plain = [w for w in words if b"<|" not in w]
        ids = dict(zip(plain, encoder.distinct(plain)))
        ids |= {w: encoder.whole(w.decode()).tobytes() for w in words if b"<|" in w}
        own = [ids[w] for w in words]
        return [], np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), np.int64, len(own)) // 4

    return facts


def encoded_blocks(docs: DataFrame, path: str) -> DataFrame:
    """block, id, data: per block one row (id BLOCK) with its packed doc_ids, offsets and ids, and one for each distinct id."""

    def finish(number, docs, facts, at, offsets):
        sizes, flat = (x.astype(np.int64) for x in facts) if facts else (np.zeros(0, np.int64),) * 2
        own = sizes[at]
        ids = word_table.gathered(flat, (np.cumsum(sizes) - sizes)[at], own)
        ends = np.concatenate([[0], np.cumsum(own)])[offsets]
        data = word_table.packed(np.array([d or 0 for d in docs], "<i8"), np.array([d is not None for d in docs], "<u1"), word_table.smallest(ends), word_table.smallest(ids))
        used = np.unique(ids)
        block = pa.array(np.full(len(used) + 1, number))
        rows = pa.array([data] + [None] * len(used), pa.binary())
        return pa.RecordBatch.from_arrays([block, pa.array(np.append(BLOCK, used), pa.int32()), rows], ["block", "id", "data"])

    answers = word_table.answered(word_table.bucket_rows(docs, split), ids_of_words(path))
    return word_table.joined_back(docs, split, answers, finish, "block long, id int, data binary")


def documents_of(data):
    """doc_ids, ends and ids of a packed block."""
    numbers, valid, ends, ids = word_table.unpacked(data)
    return [d if v else None for d, v in zip(numbers.tolist(), valid.tolist())], ends.astype(np.int64), ids


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of every row."""

    def unpack(batches):
        for batch in batches:
            for data in batch.column("data").to_pylist():
                docs, ends, ids = documents_of(data)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), lists], ["doc_id", "ids"])

    return encoded_blocks(docs, path).where(F.col("id") == BLOCK).select("data").mapInArrow(unpack, "doc_id long, ids array<int>")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """id, piece of every token of the vocabulary."""
    from tokenizers import Tokenizer

    table = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    return spark.createDataFrame([(i, t) for t, i in table.items()], "id int, piece string")


def decode(spark: SparkSession, encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: ids (array of int) joined to the pieces of the vocabulary, in order."""
    rows = encoded.withColumn("row", F.monotonically_increasing_id())
    found = rows.select("row", F.posexplode("ids").alias("at", "id")).join(F.broadcast(pieces(spark, path)), "id").groupBy("row")
    text = found.agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p")).select("row", F.array_join("p.piece", " ").alias("text"))
    return rows.join(text, "row", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def decoded_blocks(blocks: DataFrame, path: str) -> DataFrame:
    """Number and digest of every document's ids, and digest of the text of their pieces. blocks: see encoded_blocks.

    A join with a broadcast table leaves the rows of a task in their order, so that a block is
    followed by its ids and their pieces without another shuffle; if it weren't, that is an error.
    """

    def close(data, used, names):
        docs, ends, ids = documents_of(data)
        place = np.full(max(int(ids.max(initial=0)), int(used.max(initial=0))) + 1, -1)
        place[used] = np.arange(len(used))
        own = place[ids.astype(np.int64)]
        if (own < 0).any():
            raise ValueError("a block is apart from its pieces")
        at, offsets = pa.array(own), pa.array(ends, pa.int32())
        digests = []
        for table in (pa.array([str(i) for i in used.tolist()], pa.string()), pa.array(names, pa.string())):
            texts = pc.binary_join(pa.ListArray.from_arrays(offsets, table.take(at)), " ")
            digests.append(pa.array([hashlib.sha256(t.as_buffer()).hexdigest() if n else hashlib.sha256().hexdigest() for t, n in zip(texts, np.diff(ends).tolist())]))
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(np.diff(ends)), *digests], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def run(batches):
        data, used, names = None, [], []
        for batch in batches:
            for i, own, piece in zip(*(batch.column(c).to_pylist() for c in ("id", "data", "piece"))):
                if i == BLOCK:
                    if data is not None:
                        yield close(data, np.array(used, np.int64), names)
                    data, used, names = own, [], []
                else:
                    used.append(i)
                    names.append(piece)
        if data is not None:
            yield close(data, np.array(used, np.int64), names)

    joined = blocks.join(F.broadcast(pieces(blocks.sparkSession, path)), "id", "left")
    return joined.select("id", "data", "piece").mapInArrow(run, SCHEMA)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """The rows of SCHEMA for every row of docs: encoded, then decoded from the ids."""
    return decoded_blocks(encoded_blocks(docs, path), path)


def op5_bpe(spark, sf_dir):
    return round_trip(common.table(spark, sf_dir, "documents"), tokens.vocabulary_path())
