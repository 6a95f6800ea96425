import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import near_dedup, packing, tokens, toxicity

from .helpers import DOCS, ODD, documents


def brute(texts):
    """n_shingles and least linked document of each text, by comparing all pairs."""
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed, n=120):
    rng, out = random.Random(seed), []
    for _ in range(n):
        if out and rng.random() < 0.7:
            w = rng.choice(out[:6]).split()
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"X{rng.randrange(50)}"
            out.append(rng.choice([" ", "\n"]).join(w))
        else:
            out.append(" ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 20, 60, 150]))))
    return [*out, *ODD]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup(spark, seed):
    texts = corpus(seed)
    want = brute(texts)
    rows = sorted(near_dedup.near_groups(documents(spark, texts, seed == 1), block=4 if seed == 1 else 1024).collect())
    assert [(r.n_shingles, r.component_id) for r in rows] == want
    assert [r.kept for r in rows] == [c == i for i, (_, c) in enumerate(want)]


def test_sketch_estimates_similarity():
    a, b = np.arange(1, 400, dtype=np.uint64), np.arange(100, 500, dtype=np.uint64)
    s = near_dedup.sketches(near_dedup.mix(np.concatenate([a, b, a[:1]])), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + 1]), 128)
    assert abs((s[0] == s[1]).mean() - 300 / 499) < 0.15
    assert (s != np.uint64(2**64 - 1)).all()


def test_near_dedup_empty(spark):
    assert near_dedup.near_groups(spark.createDataFrame([], DOCS)).count() == 0


def cases(n=1200):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(n):
        w = [f"w{rng.randrange(400)}" for _ in range(40)]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(4):
                w[rng.randrange(40)] = rng.choice(["Nasty,", "vile", "rotten."])
        texts.append(" ".join(w))
        labels.append((i, int(bad)))
    return texts, labels


def test_toxicity(spark):
    texts, labels = cases()
    table = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.classified(documents(spark, [*texts, *ODD], True), table).collect()
    assert len(rows) == len(texts) + len(ODD) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < len(texts)]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held) and len(held) > 200
    right = sum(r.predicted == dict(labels)[r.doc_id] for r in held) / len(held)
    assert right > 0.97


def test_toxicity_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.classified(spark.createDataFrame([], DOCS), labels).count() == 0
    assert [r.score for r in toxicity.classified(documents(spark, ["a b"]), labels).collect()] == [0.0]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts, labels = cases(300)
    texts = [*texts, texts[0], texts[1] + " tail", *ODD]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, str(tmp_path))
        assert left.columns == docs.columns
        docs = spark.createDataFrame(left.collect(), left.schema)
    kept = sorted(docs.collect())
    linked = brute([r.text for r in kept])
    assert [c for _, c in linked] == list(range(len(kept)))
    want = sorted(tuple(r)[:6] for r in packing.pack_documents(docs, tokens.vocabulary_path()).drop("sequence_id", "offset").collect())
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_ftrl_against_a_plain_loop():
    rng = random.Random(9)
    cases = [(sorted(rng.sample(range(12), rng.randrange(1, 6))), rng.randrange(2)) for _ in range(200)]
    model = toxicity.Ftrl(12, l1=0.5)
    z, n = [0.0] * 13, [0.0] * 13

    def weight(i):
        l1 = 0.0 if i == 12 else 0.5
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((1.0 + n[i] ** 0.5) / 0.3)

    for places, label in cases:
        model.learn(np.array(places), label)
        own = [*places, 12]
        g = 1 / (1 + np.exp(-sum(weight(i) for i in own))) - label
        steps = [(i, g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.3 * weight(i)) for i in own]
        for i, d in steps:
            z[i], n[i] = z[i] + d, n[i] + g * g
    assert np.allclose(model.weights(np.arange(13)), [weight(i) for i in range(13)])
    rare = toxicity.Ftrl(12, l1=4.0)
    rare.learn(np.array([3]), 1)
    assert rare.weights(np.array([3]))[0] == 0 != rare.weights(np.array([12]))[0]


def test_features_of_a_text():
    one = lambda text: sorted(toxicity.features(pa.array([text], pa.string()), 20)[1].tolist())
    a, b, c = one("a"), one("b"), one("c")
    assert len(a) == 1 and len(one("a b c")) == 6  # three words, two pairs, one pair with a gap
    assert set(a) | set(b) | set(c) <= set(one("A, b c!")) and one("a b") != one("b a")
    assert one(None) == one("") == []


def test_toxic_rows_go_by_their_text(spark):
    texts, labels = cases()
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = documents(spark, texts, True)
    odd = docs.where("doc_id < 30").selectExpr("null as doc_id", *docs.columns[1:]).unionByName(docs.where("doc_id < 30").selectExpr("7 as doc_id", *docs.columns[1:]))
    both = docs.unionByName(odd.select(odd.doc_id.cast("long").alias("doc_id"), *docs.columns[1:]))
    left = toxicity.survivors(both, table.where("doc_id <> 7"))
    assert left.columns == docs.columns
    clean = {t for t, (_, bad) in zip(texts, labels) if not bad}
    kept = [r.text for r in left.where("doc_id is null or doc_id = 7").collect()]
    assert len(set(kept) ^ {t for t in texts[:30] if t in clean}) <= 2
