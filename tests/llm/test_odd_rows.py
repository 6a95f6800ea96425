"""Repeated rows, rows without id, very long texts and columns of clashing names, operator by operator."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import bpe, common, licenses, near_dedup, packing, tokens, toxicity, warc

from .helpers import DOCS, documents, ids_of

LINE = "Licensed under the MIT License."


def rows_of(spark, rows):
    """doc_id and text, with columns that bear the operators' own names."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("digest", "license", "whole", "unit", "block", "ids", "n_shingles", "kept", "score", "sequence_id", "offset", "length", "start")})


def test_every_known_text_has_a_sign(spark):
    rows = spark.createDataFrame([(t,) for _, t in licenses.KNOWN], "t string")
    assert rows.where(~licenses.may_match(F.col("t"))).count() == 0
    assert all(" license " in f" {r.n} " or " permission " in f" {r.n} " for r in rows.select(licenses.normalised(F.col("t")).alias("n")).collect())


def test_signs_lose_no_match(spark, monkeypatch):
    texts = ["LICENCED under the mit Licence", "released UNDER the  MIT license", "sublicensing under the MIT license.", "lİcensed under the MIT license", "li censed under the MIT license", "Re-leased under the MIT license", "Licenſed under the MIT License", "K license", LINE + "\n" + LINE, "x" * 300, None, licenses.KNOWN[-2][1].lower()]
    with_signs = sorted(licenses.scan(documents(spark, texts)).collect())
    monkeypatch.setattr(licenses, "SIGNS", ("", "", ""))
    assert with_signs == sorted(licenses.scan(documents(spark, texts)).collect())
    assert [r.licenses for r in with_signs][:3] == ["MIT", "MIT", "MIT"]


def test_licenses(spark):
    long = "word " * 60000 + "\n" + LINE + "\n" + "x" * 500000
    rows = [(1, LINE), (1, LINE), (None, LINE), (2, long), (3, None)]
    found = licenses.scan(rows_of(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.whole_license, r.licenses) for r in found if r.doc_id in (1, 2, 3)) == [(1, "MIT", "MIT"), (1, "MIT", "MIT"), (2, None, "MIT"), (3, None, "")]
    assert len(found) == len(rows)


def test_bpe(spark):
    rows = [(1, "the cat"), (1, "the cat"), (1, "a dog"), (None, "the cat"), (2, "word " * 30000)]
    found = bpe.round_trip(rows_of(spark, rows), tokens.vocabulary_path()).collect()
    digest = lambda t: hashlib.sha256(" ".join(map(str, ids_of(t))).encode()).hexdigest()
    assert sorted((r.doc_id or 0, r.ids_sha256) for r in found) == sorted((d or 0, digest(t)) for d, t in rows)


def test_toxicity(spark):
    rows = [(1, "vile words"), (1, "vile words"), (1, "kind words"), (None, "vile words"), (2, "word " * 30000)]
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (None, 1), (2, 0), (2, None)], "doc_id long, toxic int")
    found = toxicity.classified(rows_of(spark, rows), labels).collect()
    assert sorted(r.doc_id or 0 for r in found) == [0, 1, 1, 1, 2]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)


def test_near_dedup(spark):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(5, a), (5, a), (3, a + " more"), (None, a), (7, "other words that nobody else has at all"), (8, None), (9, "word " * 30000)]
    found = near_dedup.near_groups(rows_of(spark, rows)).collect()
    assert len(found) == len(rows)
    assert {r.component_id for r in found if r.doc_id in (3, 5)} == {3}
    assert {r.doc_id: r.component_id for r in found if r.doc_id in (7, 8, 9)} == {7: 7, 8: 8, 9: 9}
    assert {r.doc_id: r.n_shingles for r in found if r.doc_id in (8, 9)} == {8: 0, 9: 1}


def test_packing(spark):
    rows = [(1, "the cat"), (1, "the cat"), (None, "a"), (2, None)]
    found = packing.pack_documents(rows_of(spark, rows), tokens.vocabulary_path()).collect()
    sums = {}
    for r in found:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
    assert sums == {1: 2 * (len(ids_of("the cat")) + 1), None: len(ids_of("a")) + 1, 2: 1}
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found)


def test_warc(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (2, "u", "same"), (4, "u", None), (5, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("digest", "record_type", "refers_to", "payload", "size", "part")})
    folder = common.shared_folder(spark, "warc")
    warc.write_archives(pages, folder)
    found = warc.read_archives(spark, folder).collect()
    assert len(found) == len(rows)
    assert {(r.page_id, r.refers_to) for r in found if r.record_type == "revisit"} <= {(1, 2), (2, 2), (4, 5)}
    assert {r.payload_digest for r in found if r.page_id in (1, 2)} == {base64.b32encode(hashlib.sha1(b"same").digest()).decode()}


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline(spark, tmp_path, empty):
    import corpus_pipeline

    texts = ["the cat sat on the mat", "", None, "word " * 30000]
    rows = [] if empty else [(i, t, None, "s", 0) for i, t in enumerate(texts)] + [(0, texts[0], None, "s", 0), (None, texts[0], None, "s", 0), (0, "another text of that id", None, "s", 0)]
    spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("kept", "score", "digest", "block", "component_id")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({r.sequence_id for r in found}) == len(found)
    want = {} if empty else {0: len(ids_of(texts[0])) + len(ids_of("another text of that id")) + 2, 1: 1, 3: len(ids_of(texts[3])) + 1}
    sums = {}
    for r in found:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
    assert sums == want


def test_licenses_in_typographic_dress(spark):
    """Curly quotes, dashes and bullets are punctuation like the plain ones, and equivalent spellings one word."""
    mit = [t for k, t in licenses.KNOWN if k == "MIT" and len(t) > 300][0]
    curly = mit.replace('"Software"', "\u201cSoftware\u201d").replace('"AS IS"', "\u00abAS IS\u00bb").replace(", and to permit", " \u2014 and to permit")
    line = "Licensed under the Apache License, Version 2.0."
    texts = [curly, f"\u201c{line}\u201d", f"\u2022 {line}", f"{line} \u2014", f"x\n\u2013 {line}\ny", "\u00e9" + line, curly.replace("CLAIM", "CLAIMS"), "Licenced under the Apache Licence 2.0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.whole_license, r.licenses) for r in licenses.scan(docs).collect()}
    assert got[0][0] == "MIT" and got[1] == got[2] == got[3] == ("Apache-2.0", "Apache-2.0") and got[4] == (None, "Apache-2.0")
    assert got[5] == (None, "") and got[6][0] is None and got[7] == ("Apache-2.0", "Apache-2.0")
    words = docs.select(licenses.spelled(F.lit("the organisation may realise a per cent whilst")).alias("w")).first().w
    assert words == "the organization may realize a per cent while"
