import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import bpe, common, tokens, word_table

from .helpers import DOCS, ODD, documents, ids_of, tokenizer


def test_round_trip(spark):
    texts = [*ODD, "<|STARTOFTEXT|> Ab", "x<|endoftext|>y", "a a a b, b. !!"]
    rows = sorted(bpe.round_trip(documents(spark, texts, True), tokens.vocabulary_path()).collect())
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts):
        ids = ids_of(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tokenizer().decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_decode(spark):
    docs = documents(spark, [t for t in ODD if len(t or "") < 1000])
    encoded = bpe.encode(docs, tokens.vocabulary_path())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.ids for r in encoded.collect()} == {d: ids_of(t) for d, t in texts.items()}
    decoded = {r.doc_id: r.text for r in bpe.decode(spark, encoded, tokens.vocabulary_path()).collect()}
    assert decoded == {d: tokenizer().decode(ids_of(t), skip_special_tokens=False) for d, t in texts.items()}


def test_empty(spark):
    assert bpe.round_trip(spark.createDataFrame([], DOCS), tokens.vocabulary_path()).count() == 0


@pytest.mark.parametrize("cut", [word_table.CUT, (200, 1 << 21, 64 << 20), (200, 60, 64 << 20), (1, 1, 1)])
def test_words_of_a_split_are_dealt_once(spark, cut):
    texts = [*[f"word{i % 50} and w{i} more" for i in range(300)], None, "", "one " * 500]
    docs = documents(spark, texts).repartition(3, "doc_id").cache()

    def facts(words, counts):
        return [np.array([len(w) for w in words])], np.zeros(0, "<u4"), np.zeros(len(words), np.int64)

    def finish(block, ids, facts, at, offsets):
        sizes = np.concatenate([[0], np.cumsum(facts[0].astype(np.int64)[at] if facts else [])])[offsets]
        return pa.RecordBatch.from_arrays([pa.array([block] * len(ids)), pa.array(ids, pa.int64()), pa.array(np.diff(sizes).astype(np.int64))], ["block", "doc_id", "letters"])

    rows = word_table.bucket_rows(docs, common.word_codes, cut=cut).cache()
    answers = word_table.answered(rows, facts)
    got = word_table.joined_back(docs, common.word_codes, answers, finish, "block long, doc_id long, letters long", cut).collect()
    assert {r.doc_id: r.letters for r in got} == {i: len("".join((t or "").split())) for i, t in enumerate(texts)} and len(got) == len(texts)
    spans, blocks = rows.select("span").distinct().count(), len({r.block for r in got})
    assert rows.count() <= spans * word_table.buckets_of(docs) and spans <= blocks
    if cut[1] == 1 << 21:
        assert spans == 3 and (cut[0] > 200 or blocks > 20)


def test_changed_input_is_an_error(spark):
    one, two = (documents(spark, [f"a b {x}"]).coalesce(1) for x in "cd")
    answers = word_table.answered(word_table.bucket_rows(one, bpe.split), bpe.ids_of_words(tokens.vocabulary_path()))
    with pytest.raises(Exception, match="changed between two reads"):
        word_table.joined_back(two, bpe.split, answers, lambda *a: None, "block long").collect()
