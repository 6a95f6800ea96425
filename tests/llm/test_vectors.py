import numpy as np

from tallyloom.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, number string"


def brute(rows, least=0.93):
    def good(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    root, links = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    own = [(i, np.array(v, np.float32).astype(float), label) for i, v, label, _ in rows if good(v, label)]
    for k, (i, v, label) in enumerate(own):
        for j, w, other in own[:k]:
            if label == other and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= least:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, links[i], find(i), find(i) == i) for i in root)


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[rng.integers(12)] + rng.standard_normal(16) * rng.choice([0.1, 0.25])).tolist(), int(i % 3), "x") for i in range(300)]
    rows += [(300 + i, rows[5][1], 2, "x") for i in range(40)]
    rows += [(400, None, 1, "x"), (401, [0.0] * 16, 1, "x"), (402, [float("nan")] + [1.0] * 15, 1, "x"), (403, [None] + [1.0] * 15, 1, "x"), (404, rows[0][1], None, "x"), (405, [], 1, "x"), (406, [1.0], 1, "x"), (407, [float("inf")] * 16, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    for shard_size in (50, 8192):
        assert sorted(map(tuple, vector_dedup.near_vectors(df, shard_size=shard_size).collect())) == brute(rows)


def test_graph_recall():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 24)) + 3 * rng.standard_normal((50, 24))[rng.integers(50, size=2000)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = vector_dedup.Graph(x)
    q, n = vector_dedup.audited(graph, x[:500], 0.9, 32, 0.999)
    assert len(q) >= 0.99 * (x[:500] @ x.T >= 0.9).sum()


def test_unreachable_nodes_are_compared():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = vector_dedup.Graph(x)
    graph.layers = [(np.zeros(301, np.int64), np.zeros(0, np.int32))]  # no way to any node
    q, n = vector_dedup.audited(graph, x, 0.6, 8, 0.999, np.arange(300))
    assert len(q) == ((x @ x.T >= 0.6).sum() - 300)


def test_repeated_and_missing_ids(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(7, a, 1, "x"), (7, b, 1, "x"), (9, b, 1, "x"), (None, a, 1, "x"), (None, [1.0, 1.0], 1, "x")]
    got = sorted(vector_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect(), key=str)
    want = [(7, 1, 7, True), (7, 1, 7, True), (9, 1, 7, False), (None, 1, 7, False), (None, 0, None, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty(spark):
    assert vector_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
