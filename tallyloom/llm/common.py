"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import shared_folder, written

__all__ = ["END_ID", "byte_strings", "open_fs", "partitions", "put", "rename", "shared_folder", "slices", "table", "term_table", "text_digest", "texts", "translated", "without", "word_codes", "written"]

END_ID = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text; null counts as empty."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_digest(text) -> F.Column:
    """SHA-256 of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def without(docs: DataFrame, decided: DataFrame, digest: F.Column) -> DataFrame:
    """The rows of docs that decided (doc_id, digest, kept; one row for each row of docs) keeps.

    Rows are told apart by doc_id and digest, so another text of the same doc_id stays; null
    doc_ids are equal. Of repeated rows that are kept one stays. All columns of docs come back.
    """
    own, key, sign = docs.columns, "__doc_id", "__digest"
    marked = docs.withColumn(sign, digest)
    gone = decided.where("not kept").select(F.col("doc_id").alias(key), F.col("digest").alias("__gone")).distinct()
    left = marked.join(gone, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(sign) == F.col("__gone")), "left_anti")
    if decided.where("kept").groupBy("doc_id", "digest").count().where("count > 1").limit(1).count():
        left = left.dropDuplicates(["doc_id", sign])
    return left.select(*(F.col(f"`{c}`") for c in own))


def open_fs(uri: str):
    """(file system, path) of a URI, for tasks that write or read files of their own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, name: str, data: bytes) -> None:
    """Writes a file under a temporary name, then renames it: a retried task replaces it whole."""
    system, path = open_fs(uri)
    system.create_dir(path, recursive=True)
    temporary = f"{path}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        out.write(data)
    rename(system, temporary, f"{path}/{name}")


def rename(system, temporary: str, final: str) -> None:
    from pyarrow import fs

    if not isinstance(system, fs.LocalFileSystem) and system.get_file_info(final).type != fs.FileType.NotFound:
        system.delete_file(final)
    system.move(temporary, final)


def word_codes(texts):
    """Words of a string array with A-Z lowered: (distinct words as bytes, each word's number, where each text's words begin and end).

    Words are runs of anything but ASCII white space.
    """
    import numpy as np
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    words = byte_strings(coded.dictionary)
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    if b"" in words:  # what splitting an empty text gives
        full = at != words.index(b"")
        before = np.concatenate([[0], np.cumsum(full)])
        at, offsets = at[full], before[offsets]
    return words, at, offsets


def byte_strings(values) -> list[bytes]:
    """The values of an array of strings without nulls."""
    import numpy as np
    import pyarrow as pa

    values = values.cast(pa.large_binary())
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1].tolist()
    data = values.buffers()[2]
    data = data.to_pybytes() if data is not None else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def slices(texts, at_once: int = 8 << 20):
    """Yields (from, to) so that each run of texts has about at_once bytes."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + at_once)))
        yield at, to
        at = to


def translated(texts, table: bytes):
    """A string array with every byte replaced by table[byte]; table must keep bytes from 0x80 on."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    own = bytes(memoryview(data)[offsets[0] : offsets[-1]]) if data is not None else b""
    moved = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(own.translate(table)))
    return moved.cast(pa.string())


def term_table(digits: bool) -> bytes:
    """For translated(): A-Z lower-cased, letters (and digits) of ASCII and all bytes from 0x80 on kept, others a space."""
    keep = lambda b: b >= 0x80 or chr(b).isalpha() or digits and chr(b).isdigit()
    return bytes(ord(chr(b).lower()) if b < 0x80 and keep(b) else b if keep(b) else 0x20 for b in range(256))
