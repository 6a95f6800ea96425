"""Token-id files: each document's ids compressed on their own with a shared dictionary.

File format (little-endian). A shard is a run of zstandard frames, one per document in
ascending doc_id order, each holding the ids as unsigned integers of the header's width,
compressed with the shared dictionary. The footer has doc_id (int64, with a byte that is 0 where there is none), number of
ids (uint32) and frame end (uint64) of each document, then 8 bytes number of documents, 8 bytes width,
32 bytes SHA-256 of the dictionary and the 8 bytes of MAGIC, so that one document is read by
one look at the footer and one short range. The folder also holds the dictionary and, written
last, manifest.json with the shards in order and the ids before each.

Shards are written under temporary names and renamed, so a repeated task replaces its shard
whole. Null text is empty: such a document is the end id alone. Rows with the same doc_id stay
apart, next to each other; rows without doc_id come first. The dictionary is trained on the ids of
a bounded sample of documents; where the sample is too small to train on, it is the sample itself. A table without rows gives a folder without shards and no rows back.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"TLTOKEN1"
INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("n_tokens", "<u4"), ("end", "<u8")])
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def train_dictionary(docs: DataFrame, path: str, sample: int = 1000, ids_each: int = 4096, size: int = 32768, width: int = 2) -> bytes:
    """A zstandard dictionary from at most sample documents (the doc_ids of the least hashes, chosen before any text is read), ids_each ids of each."""
    import zstandard

    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = common.texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", F.substring("text", 1, 8 * ids_each).alias("text"))
    rows = some.groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    encoder = tokens.encoder(path)
    samples = [ids[:ids_each].astype(f"<u{width}").tobytes() for ids in encoder.encode(pa.array([r.text for r in rows], pa.string()))]
    try:
        return zstandard.train_dictionary(size, [s for s in samples if len(s) >= 8]).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return b"".join(samples)[-size:]


def write_shards(docs: DataFrame, path: str, folder: str, width: int = 2, level: int = 3) -> dict:
    """Writes all documents and returns the manifest."""
    import zstandard

    trained = train_dictionary(docs, path, width=width)
    digest = hashlib.sha256(trained).digest()
    common.put(folder, "dictionary", trained)
    end_id = np.array([common.END_ID], "<u4")

    def write(batches):
        encoder, part = tokens.encoder(path), TaskContext.get().partitionId()
        packer = zstandard.ZstdCompressor(level, zstandard.ZstdCompressionDict(trained) if trained else None)
        system, base = common.open_fs(folder)
        name = f"shard-{part:06d}.tok"
        temporary, index, total, at, out = f"{base}/_{name}.{uuid.uuid4().hex}", [], 0, 0, None
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                out = out or system.open_output_stream(temporary)
                ids = np.concatenate([ids, end_id])
                frame = packer.compress(ids.astype(f"<u{width}").tobytes())
                out.write(frame)
                at += len(frame)
                total += len(ids)
                index.append((doc or 0, doc is not None, len(ids), at))
        if out is None:
            return
        out.write(np.array(index, INDEX).tobytes() + np.array([len(index), width], "<u8").tobytes() + digest + MAGIC)
        out.close()
        common.rename(system, temporary, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "docs": [len(index)], "tokens": [total]})

    n = common.partitions(docs.sparkSession)
    ranged = common.texts(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    shards = sorted(ranged.mapInArrow(write, "part long, file string, docs long, tokens long").collect())
    manifest, start = {"dictionary_sha256": digest.hex(), "width": width, "shards": []}, 0
    for s in shards:
        manifest["shards"].append({"file": s.file, "docs": s.docs, "tokens": s.tokens, "start": start})
        start += s.tokens
    common.put(folder, "manifest.json", json.dumps(manifest).encode())
    return manifest


def load_manifest(folder: str) -> dict:
    system, base = common.open_fs(folder)
    with system.open_input_stream(f"{base}/manifest.json") as f:
        return json.loads(f.read())


def read_index(file, digest: str) -> tuple[np.ndarray, int]:
    """A shard's index and width; fails if the dictionary is another one."""
    size = file.size()
    file.seek(size - 56)
    footer = file.read(56)
    if footer[48:] != MAGIC or footer[16:48].hex() != digest:
        raise ValueError("not a shard of this dictionary")
    n, width = np.frombuffer(footer[:16], "<u8").tolist()
    file.seek(size - 56 - n * INDEX.itemsize)
    return np.frombuffer(file.read(n * INDEX.itemsize), INDEX), width


def frames(folder: str, shard: str, digest: str, at_once: int = 4 << 20):
    """Yields (doc_id, ids) of a shard in order, reading about at_once bytes at a time."""
    import zstandard

    system, base = common.open_fs(folder)
    with system.open_input_stream(f"{base}/dictionary") as f:
        trained = f.read()
    unpacker = zstandard.ZstdDecompressor(zstandard.ZstdCompressionDict(trained) if trained else None)
    with system.open_input_file(f"{base}/{shard}") as f:
        index, width = read_index(f, digest)
        ends, i, before = index["end"], 0, 0
        while i < len(index):
            j = max(i + 1, int(np.searchsorted(ends, before + at_once, "right")))
            f.seek(before)
            data = memoryview(f.read(int(ends[j - 1]) - before))
            at = 0
            for row in index[i:j]:
                to = int(row["end"]) - before
                yield int(row["doc_id"]) if row["known"] else None, np.frombuffer(unpacker.decompress(data[at:to]), f"<u{width}").astype("<u4")
                at = to
            i, before = j, int(ends[j - 1])


def read_document(folder: str, shard: str, number: int, digest: str) -> np.ndarray:
    """The ids of one document of a shard, by its place: reads the footer and that one frame."""
    import zstandard

    system, base = common.open_fs(folder)
    with system.open_input_stream(f"{base}/dictionary") as f:
        trained = f.read()
    with system.open_input_file(f"{base}/{shard}") as f:
        index, width = read_index(f, digest)
        begin = int(index["end"][number - 1]) if number else 0
        f.seek(begin)
        frame = f.read(int(index["end"][number]) - begin)
    unpacker = zstandard.ZstdDecompressor(zstandard.ZstdCompressionDict(trained) if trained else None)
    return np.frombuffer(unpacker.decompress(frame), f"<u{width}").astype("<u4")


def read_shards(spark, folder: str) -> DataFrame:
    """Per document, from the files: the ids of all documents before it, their number and their checksum."""
    manifest = load_manifest(folder)
    digest, shards = manifest["dictionary_sha256"], manifest["shards"]
    if not shards:
        return spark.createDataFrame([], SCHEMA)

    def read(batches):
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                rows, start = [], shards[shard]["start"]
                for doc, ids in frames(folder, shards[shard]["file"], digest):
                    rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(read, SCHEMA)


def op4_token_files(spark, sf_dir):
    folder = common.shared_folder(spark, "tokens")
    write_shards(common.table(spark, sf_dir, "documents"), tokens.vocabulary_path(), folder)
    return read_shards(spark, folder)
