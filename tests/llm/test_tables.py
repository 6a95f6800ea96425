import base64
import hashlib
import io
import re

import pytest

from tallyloom.llm import common, exact_dedup, licenses, near_dedup, warc

from .helpers import DOCS, ODD, documents


@pytest.mark.parametrize("extra", [False, True])
def test_exact_dedup(spark, extra):
    docs = documents(spark, ODD * 20, extra)
    rows = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, capacity=2).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in ODD * 20]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert (rows[i].keep_id, rows[i].group_size, rows[i].kept) == (min(same), len(same), min(same) == i)
        assert rows[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    left = exact_dedup.survivors(docs.union(docs))
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, t in enumerate(norm) if norm.index(t) == i)
    assert left.columns == docs.columns


def test_directory_doubles_until_nothing_is_overfull(spark):
    keys = spark.createDataFrame([((i * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63),) for i in range(500)], "fp long")
    depth, slots = exact_dedup.directory(keys, 3, step=2)
    table = {r.slot: r.bucket for r in slots.collect()}
    found = [table[((r.fp % (1 << 64)) >> (64 - depth))] for r in keys.collect()]
    assert len(table) <= 1 << depth and max(found.count(b) for b in set(found)) <= 3


@pytest.mark.parametrize("bits", [16, 2])
def test_one_deep_bucket_beside_shallow_ones(spark, monkeypatch, bits):
    """Ten keys that differ in the last bits only, and two far ones: 62 bits deep, without a doubling for each bit."""
    monkeypatch.setattr(exact_dedup, "SLOT_BITS", bits)
    keys = spark.createDataFrame([((5 << 40) + i,) for i in range(10)] + [(-(1 << 62),), (1 << 62,)], "fp long")
    depth, slots = exact_dedup.directory(keys, 2)
    assert slots.count() <= (1 << depth) + 70
    rows = exact_dedup.routed(keys, depth, slots).collect()
    found = {}
    for r in rows:
        found.setdefault(r.bucket, []).append(r.fp)
    assert len(rows) == 12 and all(len(f) <= 2 or len({(x % (1 << 64)) >> 2 for x in f}) == 1 for f in found.values()) and len(found) >= 4


def test_exact_dedup_with_equal_high_bits(spark, monkeypatch):
    from pyspark.sql import functions as F

    texts = [f"t{i % 9}" for i in range(30)]
    monkeypatch.setattr(exact_dedup, "keyed", lambda d: d.select("doc_id", exact_dedup.normalised(F.col("text")).alias("norm"), (F.expr("cast(substr(text, 2) as long)") * 4 + 64).alias("fp")))
    rows = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(documents(spark, texts), capacity=2).collect()}
    assert rows == {i: (i % 9, texts.count(t)) for i, t in enumerate(texts)}


def test_near_copies_without_id(spark):
    """Rows without doc_id link by their own texts; their group's component_id is the least doc_id it has."""
    t = " ".join(f"w{i}" for i in range(200))
    rows = [(3, t), (None, t + " more"), (None, "one " + t + " more"), (None, "quite " + t), (9, "another text of at least five words"), (None, None)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(3, 3, True), (None, 3, False), (None, 3, False), (None, 3, False), (9, 9, True), (None, None, True)], key=str)


def test_chains_of_colliding_fingerprints(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = documents(spark, ["x", "y", "x", "z", "y", "x"])
    monkeypatch.setattr(exact_dedup, "keyed", lambda d: d.select("doc_id", exact_dedup.normalised(F.col("text")).alias("norm"), F.lit(7).cast("long").alias("fp")))
    monkeypatch.setattr(exact_dedup, "directory", lambda keys, capacity: (0, spark.createDataFrame([(0, 1)], "slot long, bucket long")))
    rows = exact_dedup.exact_dedup(docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in rows) == [(0, 0, 3), (1, 1, 2), (2, 0, 3), (3, 3, 1), (4, 1, 2), (5, 0, 3)]


def test_the_directory_leads_to_the_result(spark, monkeypatch):
    docs, real = documents(spark, ["x", "y", "x"]), exact_dedup.directory
    monkeypatch.setattr(exact_dedup, "directory", lambda keys, capacity: (lambda d, s: (d, s.where("false")))(*real(keys, capacity)))
    assert exact_dedup.exact_dedup(docs).count() == 0


@pytest.mark.parametrize("stage", ["exact", "near"])
def test_survivors_go_by_row(spark, stage):
    other, b = "quite another text of more than five words", "b b b b b b b"
    rows = [(3, b, "x"), (5, other, "x"), (5, b, "x"), (None, b, "x"), (None, "one without id", "x"), (3, b, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    left = (exact_dedup if stage == "exact" else near_dedup).survivors(docs)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(3, b, "x"), (5, other, "x"), (None, "one without id", "x")], key=str)


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


PAGES = "page_id long, url string, html string"


def test_warc(spark):
    htmls = [*ODD, *ODD, "big " * 9000]
    pages = spark.createDataFrame([(i, f"http://x.example/é {i}\r\n", h) for i, h in enumerate(htmls)] + [(None, None, "alone"), (3, "u", "a")], PAGES)
    folder = common.shared_folder(spark, "warc")
    names = warc.write_archives(pages, folder, roll_bytes=2000)
    assert len(names) > 1
    rows = warc.read_archives(spark, folder).collect()
    assert len(rows) == len(htmls) + 2
    data = [(h or "").encode() for h in htmls]
    for r in rows:
        if r.page_id is None:
            assert (r.record_type, r.refers_to) == ("response", None)
            continue
        last = max(i for i, d in enumerate(data) if d == data[r.page_id])
        assert (r.record_type, r.refers_to) == (("response", None) if last == r.page_id else ("revisit", last))
        assert r.payload_bytes == len(data[r.page_id])
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data[r.page_id]).digest()).decode()
    again = common.shared_folder(spark, "warc")
    assert warc.write_archives(pages, again, roll_bytes=2000) == names
    system, base = common.open_fs(folder)
    for n in names:
        with system.open_input_stream(f"{base}/{n}") as f, system.open_input_stream(f"{common.open_fs(again)[1]}/{n}") as g:
            assert f.read() == g.read()


def files_of(spark, folder):
    system, path = common.open_fs(folder)
    from pyarrow import fs

    return {f.base_name: system.open_input_stream(f.path, compression=None).read() for f in system.get_file_info(fs.FileSelector(path)) if f.is_file}


def test_warc_is_deterministic_over_shards(spark):
    """Many shards, repeated page_ids with other payloads, one heavy page_id, rows in another order and other partitions."""
    rows = [(i * 37 % 1009, f"u{i % 7}", f"<p>{i % 311}</p>" * (i % 5)) for i in range(2500)] + [(5000, f"h{i}", "x" * (i % 900)) for i in range(600)] + [(None, "n", f"t{i}") for i in range(300)] + [(1 << 62, "far", "z")]
    pages = spark.createDataFrame(rows, PAGES)
    one, two = common.shared_folder(spark, "warc"), common.shared_folder(spark, "warc")
    names = warc.write_archives(pages.repartition(3), one, roll_bytes=9000, shard_bytes=8000)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert warc.write_archives(spark.createDataFrame(rows[::-1], PAGES).repartition(11), two, roll_bytes=9000, shard_bytes=8000) == names
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert files_of(spark, one) == files_of(spark, two) and len(names) > 30
    got = warc.read_archives(spark, one).collect()
    own = lambda page, html: (page, len(html), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode())
    assert sorted((tuple(r[:3]) for r in got), key=str) == sorted((own(p, h) for p, _, h in rows), key=str)
    last = {}
    for p, _, h in rows:
        if p is not None:
            last[own(p, h)[2]] = max(last.get(own(p, h)[2], p), p)
    assert all(r.refers_to == (None if last.get(r.payload_digest, r.page_id) == r.page_id else last[r.payload_digest]) for r in got)


def test_warc_record_ids(spark):
    folder = common.shared_folder(spark, "warc")
    rows = [(1, "a", "x"), (1, "b", "x"), (1, "a", "y"), (2, "a", "x"), (2, "a", "z")]
    warc.write_archives(spark.createDataFrame(rows, PAGES), folder)
    fields = [warc.parse(m)[0] for name, data in files_of(spark, folder).items() if name.endswith(".gz") for m in warc.members(io.BytesIO(data))]
    ids = {f["WARC-Record-ID"]: f for f in fields}
    assert len(ids) == 5 and sorted(f["WARC-Type"] for f in fields) == ["response"] * 3 + ["revisit"] * 2
    assert all(ids[f["WARC-Refers-To"]]["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] for f in fields if f["WARC-Type"] == "revisit")


def test_warc_least_bytes(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")], PAGES)
    folder = common.shared_folder(spark, "warc")
    warc.write_archives(pages, folder, least_bytes=3)
    assert {r.page_id: r.refers_to for r in warc.read_archives(spark, folder).collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_warc_empty(spark):
    folder = common.shared_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame([], PAGES), folder)
    assert warc.read_archives(spark, folder).count() == 0


def test_licenses(spark):
    whole = "Copyright (c) 2020 Someone\n" + licenses.KNOWN[-1][1].upper().replace("MERCHANTABILITY,", "Merchantability --")
    texts = ["a b\nreleased under THE mit licence\nc", whole, None, "", "Licensed under the Apache License, version 2.0!\nLicensed under CC BY 4.0", "nothing here"]
    rows = [(r.whole_license, r.licenses, r.license_lines) for r in sorted(licenses.scan(documents(spark, texts, True)).collect())]
    assert rows[0] == (None, "MIT", 1)
    assert rows[1][0] == "MIT" and rows[1][2] >= 1
    assert rows[2:4] == [(None, "", 0)] * 2
    assert rows[4] == (None, "Apache-2.0,CC-BY-4.0", 2)
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_entire_licenses(spark):
    import textwrap

    texts = {k: t for k, t, _ in licenses.entire_texts()}
    full = {k: alone[0] for k, _, alone in licenses.entire_texts()}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "MIT", "MPL-2.0"} == set(texts)
    assert all(licenses.SIGN in t.lower() for t in texts.values())
    names = sorted(texts)
    inside = ["Some words.\n" + "\n".join(textwrap.wrap(texts[k], 60)) + "\nMore words." if k in ("MIT", "ISC") else f"Some words.\n\n{full[k]}\n\nMore words." for k in names]
    docs = [f"Copyright (c) 2020 Someone\n{full[k]}" for k in names] + inside + ["BSD 2-Clause License\n\nCopyright (c) 2020, Me\nAll rights reserved.\n\n" + texts["BSD-2-Clause"].split("\n\n", 1)[1], texts["MIT"][:-40]]
    rows = [(r.whole_license, r.licenses) for r in sorted(licenses.scan(documents(spark, docs, True)).collect())]
    assert [r[0] for r in rows[: len(names)]] == names
    assert [r[1] for r in rows[len(names) : 2 * len(names)]] == names and not any(r[0] for r in rows[len(names) : 2 * len(names)])
    assert rows[-2:] == [("BSD-2-Clause", ""), (None, "")]
