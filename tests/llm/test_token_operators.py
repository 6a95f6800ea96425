import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import common, packing, token_files, tokens

from .helpers import DOCS, ODD, documents, ids_of


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbé É.,!'sdtß…1²<|>́İΣ \n-", max_size=30), min_size=1, max_size=4))
def test_encoder_equals_tokenizer(texts):
    for text, ids in zip(texts, tokens.encoder(tokens.vocabulary_path()).encode(pa.array(texts))):
        assert ids.tolist() == ids_of(text)


def test_cache_limit():
    encoder = tokens.WordEncoder(tokens.vocabulary_path(), limit=3)
    texts = ["one two three four five six", "seven one, eight!", "two"]
    assert [i.tolist() for i in encoder.encode(pa.array(texts), at_once=5)] == [ids_of(t) for t in texts]


def test_full_cache_keeps_words_that_come_again(monkeypatch):
    encoder, learnt = tokens.WordEncoder(tokens.vocabulary_path(), limit=5), []
    plain = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda missing: learnt.extend(missing) or plain(missing))
    for text in ("one two three", "two three four five", "three five six", "five six, one two"):
        words = text.encode().split()
        assert [np.frombuffer(i, "<u4").tolist() for i in encoder.distinct(words)] == [ids_of(w.decode()) for w in words]
        assert len(encoder.known) <= 5
    assert [learnt.count(w) for w in (b"three", b"five", b"six", b",")] == [1, 1, 1, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("extra", [False, True])
def test_packing(spark, extra):
    rows = packing.pack_documents(documents(spark, ODD, extra), tokens.vocabulary_path()).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for doc, text in enumerate(ODD):
        ids, at = [*ids_of(text), 1], 0
        for r in sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start):
            assert (r.start, r.offset, r.doc_tokens) == (at, 0, len(ids))
            assert r.length <= 2048 and r.length & (r.length - 1) == 0
            assert r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)


@pytest.mark.parametrize("extra", [False, True])
def test_token_files(spark, extra):
    folder = common.shared_folder(spark, "tokens")
    docs = documents(spark, ODD * 3, extra)
    manifest = token_files.write_shards(docs.union(docs.where("doc_id = 4")), tokens.vocabulary_path(), folder)
    rows = sorted(token_files.read_shards(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([*range(len(ODD) * 3), 4])
    start = 0
    for r in rows:
        ids = [*ids_of((ODD * 3)[r.doc_id]), 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    s = manifest["shards"][0]
    assert token_files.read_document(folder, s["file"], 3, manifest["dictionary_sha256"]).tolist() == [*ids_of("a"), 1]


def test_trained_dictionary(spark):
    texts = [f"document {i} says the same thing again and again, {i * i} times over" * 20 for i in range(400)]
    folder = common.shared_folder(spark, "tokens")
    token_files.write_shards(documents(spark, texts), tokens.vocabulary_path(), folder)
    system, base = common.open_fs(folder)
    with system.open_input_stream(f"{base}/dictionary") as f:
        assert f.read()
    assert {r.doc_id: r.n_tokens for r in token_files.read_shards(spark, folder).collect()} == {i: len(ids_of(t)) + 1 for i, t in enumerate(texts)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert packing.pack_documents(docs, tokens.vocabulary_path()).count() == 0
    folder = common.shared_folder(spark, "tokens")
    token_files.write_shards(docs, tokens.vocabulary_path(), folder)
    assert token_files.read_shards(spark, folder).count() == 0


def test_token_files_keep_rows_without_id(spark):
    df = spark.createDataFrame([(2, "a b", "x"), (None, "c", "x"), (None, None, "x"), (1, "d", "x"), (1, "d", "x")], "doc_id long, text string, start string")
    folder = common.shared_folder(spark, "tokens")
    token_files.write_shards(df, tokens.vocabulary_path(), folder)
    rows = sorted(token_files.read_shards(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 1, 1, 2]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(5)]
