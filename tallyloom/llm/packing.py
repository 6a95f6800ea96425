"""Packing by power-of-two decomposition.

A document's ids with the end id are cut into pieces whose lengths are powers of two, the
longest first and none above the sequence length. A piece fills a sequence of its own length,
so no sequence crosses documents and none has padding; sequences of one length form a bucket.

Needs no shuffle: each document is cut where it is read. A document of null or empty text is
the one end id; rows with the same doc_id are packed as documents of their own. Columns other
than doc_id and text are not read. A table without rows gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common, tokens

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def lengths_of(total: int, longest: int) -> list[int]:
    """Powers of two that sum to total, the longest first, none above longest."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, path: str, longest: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece. sequence_id holds the bucket (log2 of the length), the task and a running number.

    with_ids adds the piece's ids (little-endian unsigned 32-bit integers) as a binary column.
    """
    if longest & (longest - 1):
        raise ValueError("the sequence length must be a power of two")

    def pack(batches):
        encoder, task, number = tokens.encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([common.END_ID], "<u4")
        for batch in batches:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
            out, data = {n: [] for n in names}, []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                raw, start = memoryview(np.concatenate([ids, end]).tobytes()), 0
                for length in lengths_of(len(ids) + 1, longest):
                    piece = raw[4 * start : 4 * (start + length)]
                    row = (doc, start, length, zlib.crc32(piece), len(ids) + 1, (length.bit_length() - 1) << 56 | task << 34 | number)
                    for n, x in zip(names, row):
                        out[n].append(x)
                    if with_ids:
                        data.append(bytes(piece))
                    start, number = start + length, number + 1
            arrays = [pa.array(out[n], pa.int64()) for n in names] + [pa.array([0] * len(out["doc_id"]), pa.int64())]
            if with_ids:
                arrays.append(pa.array(data, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, [*names, "offset", *["ids"] * with_ids])

    return common.texts(docs).mapInArrow(pack, SCHEMA + ", ids binary" * with_ids)


def op10_packing(spark, sf_dir):
    return pack_documents(common.table(spark, sf_dir, "documents"), tokens.vocabulary_path())
