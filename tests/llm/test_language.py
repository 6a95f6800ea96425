import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from tallyloom.llm import common, language

from .helpers import ODD

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = common.table(spark, DATA, "documents")
    got = language.op12_language(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert got.count() == docs.count() and held.n > 150 and held.right > 0.95 and 0 <= held.low <= held.high <= 1


def test_gradients():
    rng = np.random.default_rng(3)
    net = language.Network(3)
    windows, labels = rng.integers(1, 256, (5, 20)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["bias"] += 0.3
    loss = lambda: -net.log_probabilities(windows)[np.arange(5), labels].mean()
    for k, g in net.gradients(windows, labels).items():
        for at in (np.unravel_index(i, g.shape) for i in rng.choice(g.size, min(g.size, 30), replace=False)):
            if k == "filters" and not net.mask[at]:
                continue
            old, eps = net.p[k][at], 1e-6
            net.p[k][at] = old + eps
            up = loss()
            net.p[k][at] = old - eps
            down = loss()
            net.p[k][at] = old
            assert k == "bytes" and at[0] == 0 or abs((up - down) / (2 * eps) - g[at]) < 1e-4, (k, at)


def test_windows_cover_whole_texts():
    texts = ["", "ab", "x" * 255, "y" * 256, "é" * 4000, "abcdefg" * 100]
    cut, of, added = language.windows_of(pa.array(["skip", *texts])[1:])
    raw, own = [t.encode() for t in texts], cut(0, len(of))
    assert [int(added[of == i].sum()) for i in range(len(raw))] == [len(t) for t in raw]
    for i, t in enumerate(raw):
        mine = [bytes(w).rstrip(b"\0") for w in own[of == i]]
        assert all(any(t[j : j + language.SPAN] in w for w in mine) for j in range(0, len(t), 7))
        assert b"".join([*mine[:1], *(w[language.SPAN - 1 :] for w in mine[1:])]) == t


def test_windowed_score_against_plain_pass(spark):
    """A document's score from a network given by hand, position by position."""
    net = language.Network(2, seed=5)
    texts = [*ODD[:9], "Très été " * 200, "12 34", "short"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = language.predicted(docs, (["aa", "bb"], net.p), at_once=3).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        data = "".join(c.lower() if c.isascii() else c for c in t or "").encode()
        if not any(map(str.isalpha, t or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        stride, logs, at = language.WINDOW - language.SPAN + 1, [], 0
        while at == 0 or at + language.SPAN - 1 < len(data):
            w = data[at : at + language.WINDOW]
            own = [0, *w][1:] + [0] * (language.WINDOW + language.SPAN - len(w))
            best = np.full(48, -np.inf)
            for p in range(language.WINDOW):
                run = np.concatenate([net.p["bytes"][b] for b in own[p : p + language.SPAN]]).astype(float)
                best = np.maximum(best, run @ net.p["filters"])
            x = np.maximum(best + net.p["bias"], 0) @ net.p["out"] + net.p["base"]
            logs.append((len(w) - (language.SPAN - 1 if at else 0), x - np.log(np.exp(x).sum())))
            at += stride
        mean = sum(n * x for n, x in logs) / sum(n for n, _ in logs)
        assert r.lang_pred == ["aa", "bb"][int(mean.argmax())] and abs(r.score - np.exp(mean).max() / np.exp(mean).sum()) < 1e-5


def test_odd_tables(spark):
    kind = "doc_id long, text string, lang string, score string, held_out string"
    assert language.language_id(spark.createDataFrame([], kind)).count() == 0
    rows = [(i, t, None, "x", "x") for i, t in enumerate(ODD)] + [(None, "no id here", "en", "x", "x")]
    assert {(r.lang_pred, r.score) for r in language.language_id(spark.createDataFrame(rows, kind)).collect()} == {("und", 0.0)}
    rows += [(100 + i, f"les mots {i} de la ville", "fr", "x", "x") for i in range(20)] * 2 + [(100, "les mots", "fr", "x", "x")]
    got = language.language_id(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} == {"und", "fr"} and all(r.held_out is not None for r in got)
