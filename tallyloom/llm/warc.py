"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page_id. Shards are ranges of page_id of about shard_bytes of payload, cut
by exact sums of bytes per range, so they depend on the pages alone; a page_id that is heavier
than a shard is split by payload digest. Each shard's records are sorted by page_id, digest and url and
written as gzip members (one per record) to files named after the shard, which are rolled when
their compressed size passes a limit. Headers, digests and record ids are made anew from the page
alone, so the same pages give the same bytes under the same names, however rows are ordered and
dealt and whichever task is repeated. Files get temporary names, are renamed when complete, and
count only if the manifest, written last, names them.

Of pages with equal payloads (of at least least_bytes bytes), the one with the largest page_id
is a response and the others are revisit records without payload that refer to it; repeated
rows of that page are all responses. A record's id is made of page_id, payload digest and its place
among the rows that have both, so repeated page_ids have ids of their own. Null html is an empty payload. Rows of null page_id are
responses unless another page has the payload. A table without rows gives no files and no rows.
Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import urllib.parse
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string"
#: Digests that are broadcast belong to more than one page in HOT.
HOT = 10_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page, digest: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}:{place}')}>"


def record(page, url: str, payload: bytes, refers_to, date: str, place: int = 0) -> bytes:
    """One record, uncompressed."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page, digest, place)), ("WARC-Date", date),
        ("WARC-Target-URI", urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]")), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"), ("X-Page-Id", "" if page is None else page),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to, digest, 0)), ("WARC-Profile", PROFILE), ("X-Refers-To-Page", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def keys_of(pages: DataFrame) -> DataFrame:
    """page_id, digest (SHA-1 in hex) and bytes of every page, written once."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    return common.written(pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("bytes")), "page_keys")


def references(keys: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, digest and refers_to of the pages that become revisits. Digests with over 1 / HOT of all pages are broadcast."""
    keys, total = keys.where(F.col("bytes") >= least_bytes).select("page_id", "digest"), keys.count()
    shared = common.written(keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null"), "shared")
    hot = F.col("n") * HOT > total
    near = keys.join(F.broadcast(shared.where(hot)), "digest", "left")
    rest = near.where("n is null").select("page_id", "digest").join(shared.where(~hot), "digest")
    found = near.where("n is not null").unionByName(rest).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.select("page_id", "digest", "refers_to").distinct()


def placed(ids: pa.Array, cuts: np.ndarray) -> np.ndarray:
    """The range of each page_id (0 below the first cut); null ones come before all, at -1."""
    at = np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right").astype(np.int64)
    return np.where(ids.is_valid().to_numpy(zero_copy_only=False), at, -1)


def ranges(keys: DataFrame, shard_bytes: int, pieces: int = 1024) -> tuple[np.ndarray, dict[int, int]]:
    """Cuts between shards, and of shards that are too heavy although they have one page_id (or none) the number of parts.

    The span of page_ids is cut into pieces, pieces that are too heavy into more, until none is or has one
    page_id; neighbours are then put together up to shard_bytes. Weights are exact sums, so nothing depends on a
    sample. With more than `most` shards' worth of bytes the shards are larger, not more.
    """
    most = 65_536
    row = keys.agg(F.min("page_id"), F.max("page_id"), F.sum(F.col("bytes") + 1)).first()
    if row[2] is None:
        return np.zeros(0, np.int64), {}
    limit = max(shard_bytes, -(-row[2] // most))

    def weigh(cuts):
        sent = cuts

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(placed(batch.column("page_id"), sent)), batch.column("bytes")], ["at", "bytes"])

        rows = keys.select("page_id", "bytes").mapInArrow(run, "at long, bytes long").groupBy("at").agg(F.sum(F.col("bytes") + 1).alias("bytes"))
        return {r.at: r.bytes for r in rows.collect()}

    def split(low, high):
        step = -(-(high - low) // pieces)
        return list(range(low, high, max(step, 1)))

    first, end = (row[0], row[1] + 1) if row[0] is not None else (0, 1)
    cuts = split(first, end)
    while True:
        weights, edges = weigh(np.array(cuts, np.int64)), [*cuts, end]
        heavy = [i for i in range(len(cuts)) if weights.get(i + 1, 0) > limit and edges[i + 1] - edges[i] > 1]
        if not heavy:
            break
        for i in heavy:
            cuts += split(edges[i], edges[i + 1])[1:]
        cuts = sorted(cuts)
    out, now = [], 0
    for i, low in enumerate(cuts):
        own = weights.get(i + 1, 0)
        if out and now + own > limit:
            out.append(low)
            now = 0
        out = out or [low]
        now += own
    merged = np.array(out, np.int64)
    heaviest = weigh(merged)
    return merged, {at: -(-n // limit) for at, n in heaviest.items() if n > limit}


def sharded(rows: DataFrame, cuts: np.ndarray, parts: dict[int, int]) -> DataFrame:
    """rows (page_id, digest, ...) with shard and part. Only these two columns are sent to Python."""

    def shard(ids: pa.Array) -> pa.Array:
        return pa.array(placed(ids, cuts))

    def part(at: pa.Array, digest: pa.Array) -> pa.Array:
        out = np.zeros(len(at), np.int64)
        own = at.to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(np.isin(own, list(parts))).tolist():
            out[i] = int(digest[i].as_py()[:8], 16) % parts[int(own[i])]
        return pa.array(out)

    placed_rows = rows.withColumn("shard", F.arrow_udf(shard, "long")("page_id"))
    return placed_rows.withColumn("part", F.arrow_udf(part, "long")("shard", "digest")) if parts else placed_rows.withColumn("part", F.lit(0).cast("long"))


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = 64 << 20, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 3, shard_bytes: int = 16 << 20) -> list[str]:
    """Writes all pages and returns the file names of the manifest."""

    def write(batches):
        system, base, files, out, size, shard = None, None, [], None, 0, None
        page, refers, digest, place, number = object(), {}, None, 0, 0

        def close():
            out.close()
            common.rename(system, files[-1][0], f"{base}/{files[-1][1]}")

        columns = ("shard", "part", "page_id", "kind", "digest", "refers_to", "url", "html")
        for batch in batches:
            for a, b in common.slices(batch.column("html")):
                for s, part, own, kind, sign, target, url, html in zip(*(batch.column(c)[a:b].to_pylist() for c in columns)):
                    if (s, part) != shard:
                        if out is not None:
                            close()
                        out, shard, number, page = None, (s, part), 0, object()
                    if own != page:
                        page, refers, digest = own, {}, None
                    if kind == 0:
                        refers[sign] = target
                        continue
                    place = place + 1 if sign == digest else 0
                    digest = sign
                    if out is None:
                        if system is None:
                            system, base = common.open_fs(folder)
                            system.create_dir(base, recursive=True)
                        name = f"part-{s + 1:06d}-{part:05d}-{number:05d}.warc.gz"
                        files.append((f"{base}/_{name}.{uuid.uuid4().hex}", name))
                        out, size, number = system.open_output_stream(files[-1][0], compression=None), 0, number + 1
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(record(own, url, html, refers.get(sign), date, place)) + packer.flush()
                    out.write(member)
                    size += len(member)
                    if size >= roll_bytes:
                        close()
                        out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"file": pa.array([n for _, n in files], pa.string())})

    html = F.coalesce("html", F.lit("")).cast("binary")
    keys = keys_of(pages)
    cuts, parts = ranges(keys, shard_bytes)
    rows = pages.select("page_id", F.lit(1).alias("kind"), F.sha1(html).alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    marks = references(keys, least_bytes).select("page_id", F.lit(0).alias("kind"), "digest", "refers_to", F.lit("").alias("url"), F.lit(b"").alias("html"))
    dealt = sharded(rows.unionByName(marks), cuts, parts).repartition(common.partitions(pages.sparkSession), "shard", "part")
    ordered = dealt.sortWithinPartitions("shard", "part", "page_id", "kind", "digest", "url")
    names = sorted(r.file for r in ordered.mapInArrow(write, "file string").collect())
    common.put(folder, "manifest.json", json.dumps(names).encode())
    return names


def members(stream, chunk: int = 1 << 16):
    """Yields the uncompressed gzip members of a stream in turn."""
    data = stream.read(chunk)
    while data:
        unpacker, parts = zlib.decompressobj(31), []
        while True:
            parts.append(unpacker.decompress(data))
            if unpacker.eof:
                break
            data = stream.read(chunk)
            if not data:
                raise ValueError("a record is cut off")
        data = unpacker.unused_data or stream.read(chunk)
        yield b"".join(parts)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}" != fields["WARC-Block-Digest"] or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is damaged")
    return fields, block


def read_archives(spark, folder: str) -> DataFrame:
    """One row per record of the files that the manifest names; digests are checked."""
    system, base = common.open_fs(folder)
    with system.open_input_stream(f"{base}/manifest.json") as f:
        names = json.loads(f.read())
    if not names:
        return spark.createDataFrame([], SCHEMA)

    def read(batches):
        files, root = common.open_fs(folder)
        for batch in batches:
            for i in batch.column("id").to_pylist():
                with files.open_input_stream(f"{root}/{names[i]}", compression=None) as f:
                    out = []
                    for fields, block in map(parse, members(f)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind, target = fields["WARC-Type"], fields.get("X-Refers-To-Page")
                        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError("a payload is damaged")
                        page = fields["X-Page-Id"]
                        out.append((int(page) if page else None, size, digest, kind, int(target) if target else None, fields["WARC-Target-URI"]))
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri"])

    return spark.range(0, len(names), 1, len(names)).mapInArrow(read, SCHEMA)


def op9_warc(spark, sf_dir):
    folder = common.shared_folder(spark, "warc")
    write_archives(common.table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder)
