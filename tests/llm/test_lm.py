import collections
import math
import zlib

import numpy as np

from tallyloom.llm import common, lm, tokens, word_table

from .helpers import DOCS, ODD, documents, ids_of


def test_scores(spark):
    texts = [*[f"The cat number {i % 7} sat on the mat, and the dog {i % 5} barked at it." for i in range(60)], *ODD]
    rows = {r.doc_id: r for r in lm.score(documents(spark, texts, True), tokens.vocabulary_path(), 40, 150).collect()}
    words = ["".join(c.lower() if c.isascii() else c for c in t or "").encode().split() for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    count = collections.Counter(w for ws, h in zip(words, held) if not h for w in [*ws, None])
    n, v = sum(count.values()), len(count)
    for i, ws in enumerate(words):
        want = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, None])
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws) + 1, sum(count[w] > 0 for w in [*ws, None]), n)
        assert math.isclose(r.base_score, want, rel_tol=1e-9)
        assert r.score < 0
    assert sum(rows[i].score for i in range(60) if held[i]) > sum(rows[i].base_score for i in range(60) if held[i]) * 1.5


def test_distribution_and_windows():
    counts = np.zeros(lm.SIZE, int)
    counts[ids_of("some words here and there")] = 5
    model = lm.Model(counts)
    assert abs(np.bincount(model.of, np.exp(model.share.astype(float)), model.classes) - 1).max() < 1e-3
    ids = np.array([*ids_of("some words here and there " * 15), lm.END])
    whole = model.log_probabilities(ids, np.array([0, len(ids)]))
    assert (whole < 0).all()
    both = model.log_probabilities(np.concatenate([ids, ids]), np.array([0, len(ids), 2 * len(ids)]))
    assert np.allclose(both, np.concatenate([whole, whole]), atol=1e-4)
    assert np.allclose(model.log_probabilities(ids[:20], np.array([0, 20])), whole[:20], atol=1e-4)


def test_empty(spark):
    assert lm.score(spark.createDataFrame([], DOCS), tokens.vocabulary_path(), 10, 5).count() == 0


def packed_blocks(df):
    words = word_table.bucket_rows(df, common.word_codes, lm.in_training)
    answers = word_table.answered(words, lm.counted_ids(tokens.vocabulary_path()), lm.summed).cache()
    return answers, lm.blocks_of(df, answers.where("span >= 0"), lambda c: 0.0 * c)


def test_learns_from_every_window(spark):
    texts = ["so long", *[f"a text of its own with number {i} " * (i % 5) for i in range(120)]]
    _, blocks = packed_blocks(documents(spark, texts).repartition(5).cache())
    counts = np.ones(lm.SIZE, int)
    want = sum(-(-(len(ids_of(t)) + 1) // 16) for i, t in enumerate(texts) if lm.in_training(i))
    assert lm.fit(blocks, counts, 8, 1)[1] == want
    few = np.zeros(lm.SIZE, int)
    few[lm.END] = 10
    assert lm.fit(blocks, few, 1, 1, rounds=2)[1] == want * 2


def test_gradients():
    rng = np.random.default_rng(5)
    model = lm.Model(rng.integers(0, 9, lm.SIZE), groups=3, members=8, tails=8, embedded=20, width=4, stride=4)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    inputs, goal, valid = rng.integers(0, 20, (3, 8)), rng.integers(0, 24, (3, 4)), rng.random((3, 4)) < 0.8

    def loss():
        h, good, to = model.forward(inputs)[0], valid.reshape(-1), goal.reshape(-1)
        total = 0
        for i in np.flatnonzero(good):
            for z, t in ((h[i] @ model.p["g"] + model.p["gb"], to[i] // 8), (h[i] @ model.p["o"][to[i] // 8] + model.p["ob"][to[i] // 8], to[i] % 8)):
                total += np.log(np.exp(z).sum()) - z[t]
        return total / good.sum()

    found = model.gradients(inputs, goal, valid)
    for name, p in model.p.items():
        for at in rng.integers(0, p.size, 6):
            flat = p.reshape(-1)
            kept = flat[at]
            flat[at] = kept + 1e-5
            up = loss()
            flat[at] = kept - 1e-5
            slope = (up - loss()) / 2e-5
            flat[at] = kept
            assert abs(found[name].reshape(-1)[at] - slope) < 1e-4, name


def test_runs_learn_what_their_windows_do():
    rng, model = np.random.default_rng(6), lm.Model(np.arange(lm.SIZE)[::-1], stride=4)
    ids, ends = rng.integers(0, 3000, 90), np.array([0, 50, 51, 90])
    inputs, goal, valid = (np.concatenate([np.zeros((1, 4), x.dtype), x]) for x in model.laid(ids, ends))
    assert (np.flatnonzero(valid.any(1)) == [r for r in range(2, len(valid)) if r not in (15, 17)]).all()
    whole = model.gradients(inputs.reshape(1, -1), goal[1:].reshape(1, -1), valid[1:].reshape(1, -1))
    each = model.gradients(np.concatenate([inputs[:-1], inputs[1:]], 1), goal[1:], valid[1:])
    assert all(np.abs(each[k]).max() > 0 and np.allclose(whole[k], each[k], atol=1e-5) for k in model.p)


def test_training_passes_over_an_id_about_once(monkeypatch):
    model, sizes, plain = lm.Model(np.ones(lm.SIZE, int)), [], lm.Model.gradients
    monkeypatch.setattr(lm.Model, "gradients", lambda own, inputs, *more: sizes.append(inputs.size) or plain(own, inputs, *more))
    ids = np.random.default_rng(4).integers(0, lm.SIZE, 20000)
    assert model.train([(ids, np.array([0, 12000, 20000]))], 192) == 1250
    assert 20000 <= sum(sizes) < 1.25 * 20000


def test_odd_rows(spark):
    rows = [(3, "one two three", "x"), (3, "one two three", "x"), (None, "one two", "x"), (4, None, "x"), (5, "word " * 30000, "x")]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), tokens.vocabulary_path(), 8, 5).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (3, 4), (3, 4), (4, 1), (5, 30001)]
    assert len({r.score for r in got if r.doc_id == 3}) == 1 and not [r for r in got if r.doc_id is None][0].held_out


def test_short_texts_are_learnt():
    long, short = np.array([*ids_of("the cat sat on the mat again and again and then it went away for good")]), np.array([*ids_of("wolf"), lm.END])
    counts = np.bincount(np.concatenate([long, short]), minlength=lm.SIZE)
    model = lm.Model(counts)
    ends = np.array([0, len(long), len(long) + len(short)])
    model.train([(np.concatenate([long, short]), ends)] * 100, 2)
    assert model.log_probabilities(short, np.array([0, len(short)]))[-1] > -0.5


def test_words_with_marks_are_counted(spark):
    texts = ["<|ENDOFTEXT|> a<|b"] * 3 + ["plain"]
    answers, _ = packed_blocks(spark.createDataFrame([(2, t) for t in texts], "doc_id long, text string"))
    want = sum(np.bincount(ids_of(t.lower()), minlength=lm.SIZE) for t in texts)
    want[lm.END] += 4
    total, distinct, counts = lm.totals(answers, 4)
    assert (total, distinct) == (7 + 4, 3 + 1) and (counts == want).all()


def plain_score(model, ids):
    """Natural-log probability of a text, one position after the other, with loops."""
    p, s, total = model.p, model.stride, 0.0
    for t in range(len(ids)):
        first = t // s * s - s  # the window's first position; it holds the ids before each position
        rows = [model.row[ids[i - 1]] if i >= 1 else 0 for i in range(first, t + 1)]
        x = [p["e"][r].astype(float) for r in rows]
        q = x[-1] @ p["q"] / math.sqrt(model.width)
        weights = [math.exp(min(60, q @ (y @ p["k"]) + p["r"][len(x) - 1 - i])) for i, y in enumerate(x)]
        h = np.concatenate([x[-1], sum(w * (y @ p["v"]) for w, y in zip(weights, x)) / sum(weights)])
        group, member = divmod(int(model.of[ids[t]]), model.members)
        for z, goal in ((h @ p["g"] + p["gb"], group), (h @ p["o"][group] + p["ob"][group], member)):
            total += z[goal] - math.log(np.exp(z).sum())
        total += model.share[ids[t]]
    return total


def test_score_is_that_of_a_plain_pass(spark):
    texts = ["the cat sat on the mat and looked at the dog " * k for k in range(1, 6)] + ["", None, "dog"]
    docs = documents(spark, texts).cache()
    answers, blocks = packed_blocks(docs)
    ends = sum(map(lm.in_training, range(len(texts))))
    counts = lm.totals(answers, ends)[2]
    model = lm.fit(blocks.cache(), counts, 8, 12)[0]
    got = {r.doc_id: r.score for r in lm.score(docs, tokens.vocabulary_path(), 8, 12).collect()}
    for i, text in enumerate(texts):
        want = plain_score(model, [*ids_of((text or "").lower()), lm.END]) / math.log(10)
        assert math.isclose(got[i], want, rel_tol=1e-3, abs_tol=1e-3), i


def test_scores_do_not_depend_on_partitions(spark):
    docs = documents(spark, [f"a text with number {i} and the words of it " * (i % 4) for i in range(80)]).repartition(6, "doc_id").cache()
    kept, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "3", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append({r.doc_id: r.score for r in lm.score(docs, tokens.vocabulary_path(), 8, 20).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    for other in found[1:]:
        assert max(abs(other[i] - x) for i, x in found[0].items()) < 1e-3


def test_unlikely_ids_have_finite_scores():
    model = lm.Model(np.ones(lm.SIZE, int))
    model.p["gb"][:] = -100
    model.p["gb"][0] = 100  # counts as 60, the others as -60
    ids = np.flatnonzero(model.of // model.members == 1)[:5]
    found = model.log_probabilities(ids, np.array([0, len(ids)]))
    assert np.isfinite(found).all() and (found < -100).all()


def test_documents_are_split_once(spark, monkeypatch):
    passes, plain = [], common.texts
    monkeypatch.setattr(common, "texts", lambda docs: passes.append(1) or plain(docs))
    assert lm.score(documents(spark, ["one two", None, "three"] * 5), tokens.vocabulary_path(), 8, 5).count() == 15
    assert len(passes) == 1


def test_rows_of_one_pass_are_those_of_two(spark):
    docs = documents(spark, [f"number {i} of some texts, " * (i % 4) for i in range(40)] + ODD).repartition(3).cache()
    both = word_table.coded_rows(docs, common.word_codes, lm.in_training)
    words = word_table.bucket_rows(docs, common.word_codes, lm.in_training)
    assert sorted(word_table.words_of(both).collect()) == sorted(words.collect())
    answers = word_table.answered(words, lm.counted_ids(tokens.vocabulary_path())).cache()
    base = lambda c: 1.0 * c
    assert sorted(lm.blocks_from(both, answers, base).collect()) == sorted(lm.blocks_of(docs, answers, base).collect())


def test_runs_at():
    rng = np.random.default_rng(8)
    for kind in ("<u1", "<u2", "<u4"):
        sizes = rng.integers(0, 4, 50)
        flat, at = rng.integers(0, 200, sizes.sum()).astype(kind), rng.integers(0, 50, 300)
        own = np.split(flat, np.cumsum(sizes)[:-1])
        assert (word_table.runs_at(flat, sizes, at) == np.concatenate([own[i] for i in at])).all()
        assert len(word_table.runs_at(flat, sizes, at[:0])) == len(word_table.runs_at(flat[:0], sizes * 0, at)) == 0
