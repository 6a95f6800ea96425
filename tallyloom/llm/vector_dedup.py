"""Embedding near-dedup over hierarchical navigable small-world graphs, one per shard.

Vectors with the same label and components are one node with a multiplicity, so copies cost
nothing. Nodes of a label are dealt into shards of bounded size; each shard builds a graph: in
every layer a node is linked, in both directions, to near nodes that are not nearer to each
other than to it. The shards' graphs lie in files of the shared folder; each pair of shards of a
label (and each shard with itself) is one search of all nodes of one in the graph of the other.

A search walks down the layers, then expands its beam, and on from every node within the
threshold. An audit compares a fixed number of the queries with all nodes of the graph; the beam
doubles until `recall` of their links are found, and if it has reached the graph's size, the
whole block is compared by matrix products. Links are confirmed by cosine in double precision;
a search gives out how many vectors each node is linked to and a spanning forest of its links,
not the pairs. Forests are joined to components.

Vectors that are null, zero, empty, or hold null or non-finite components, and those without
label, link with nothing. Vectors of different lengths never link. Rows with the same vec_id
are vectors of their own that share the id; those without stand for no one: component_id is the
least vec_id of the component, else null. An empty table gives no rows. Columns other than
vec_id, embedding and label are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from . import common
from .word_table import gathered

FOUND = "a long, b long, linked long"


class Graph:
    """A navigable small-world graph of unit vectors (float32), searched for many queries at once."""

    def __init__(self, vectors: np.ndarray, links: int = 12, seed: int = 1):
        self.x, n = vectors, len(vectors)
        draw = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(links)).astype(int), 6)
        self.start = int(np.argmax(level)) if n else -1
        self.layers = [self._layer(np.flatnonzero(level >= l), links) for l in range(int(level.max()) + 1 if n else 0)]

    def _layer(self, members: np.ndarray, links: int):
        """Where each node's neighbours begin and end, and the neighbours."""
        x, sides = self.x[members], []
        near = min(4 * links, len(members) - 1)
        for i in range(0, len(members), 256) if near > 0 else ():
            own = np.arange(i, min(i + 256, len(members)))
            products = x[own] @ x.T
            products[np.arange(len(own)), own] = -2
            ids = np.argpartition(-products, near - 1, 1)[:, :near]
            value = np.take_along_axis(products, ids, 1)
            order = np.argsort(-value, 1, kind="stable")
            ids, value = np.take_along_axis(ids, order, 1), np.take_along_axis(value, order, 1)
            r, c = np.nonzero(self._diverse(x[ids], value, links))
            sides.append((members[own[r]], members[ids[r, c]]))
        a = np.concatenate([s[0] for s in sides] + [s[1] for s in sides]) if sides else np.zeros(0, np.int64)
        b = np.concatenate([s[1] for s in sides] + [s[0] for s in sides]) if sides else np.zeros(0, np.int64)
        edges = np.unique(a * len(self.x) + b)
        return np.searchsorted(edges, np.arange(len(self.x) + 1) * len(self.x)), (edges % len(self.x)).astype(np.int32)

    @staticmethod
    def _diverse(v: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
        """Of candidates, nearest first: those not nearer to a chosen one; half of the free places go to the nearest others."""
        each = v @ v.transpose(0, 2, 1)
        chosen = np.zeros(value.shape, bool)
        for c in range(value.shape[1]):
            nearest = np.where(chosen, each[:, c], -2).max(1)
            chosen[:, c] = (nearest < value[:, c]) & (chosen.sum(1) < most)
        free = (most - chosen.sum(1, keepdims=True)) // 2
        return chosen | (~chosen & (np.cumsum(~chosen, 1) <= free))

    def _search_layer(self, queries, entries, layer: int, beam: int, least: float, wide: int = 8):
        """The best node per query, and all pairs (query, node) met with products >= least. entries: (query, node) pairs."""
        q, n = len(queries), len(self.x)
        ends, near = self.layers[layer]
        seen, ids, value, open_ = np.zeros((q, n), bool), np.full((q, beam), -1, np.int64), np.full((q, beam), -np.inf, np.float32), np.zeros((q, beam), bool)
        done, hits = np.zeros((q, n), bool), []
        fresh = np.unique(entries[0] * n + entries[1])
        while True:
            r, node = np.divmod(fresh, n)
            seen[r, node] = True
            got = np.einsum("ij,ij->i", queries[r], self.x[node])
            hit = got >= least
            hits.append((r[hit], node[hit]))
            if len(r):
                live, place = np.unique(r), np.arange(len(r)) - np.searchsorted(r, r)
                row, shape = np.searchsorted(live, r), (len(live), int(place.max()) + 1)
                more_ids, more = np.full(shape, -1, np.int64), np.full(shape, -np.inf, np.float32)
                more_ids[row, place], more[row, place] = node, got
                all_ids, all_value = np.concatenate([ids[live], more_ids], 1), np.concatenate([value[live], more], 1)
                all_open = np.concatenate([open_[live], more_ids >= 0], 1)
                order = np.argsort(-all_value, 1, kind="stable")[:, :beam]
                ids[live], value[live] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_value, order, 1)
                open_[live] = np.take_along_axis(all_open, order, 1)
            now = open_ & (np.cumsum(open_, 1) <= wide)
            open_ &= ~now
            by, place = np.nonzero(now)
            both = np.unique(np.concatenate([by * n + ids[by, place], r[hit] * n + node[hit]]))
            by, at = np.divmod(both, n)
            left = ~done[by, at]
            by, at = by[left], at[left]
            if not len(both):
                break
            done[by, at] = True
            counts = ends[at + 1] - ends[at]
            to, by = gathered(near, ends[at], counts), np.repeat(by, counts)
            new = ~seen[by, to]
            fresh = np.unique(by[new] * n + to[new])
        return ids[:, 0], np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])

    def within(self, queries: np.ndarray, least: float, beam: int, own: np.ndarray | None = None, at_once: int = 128):
        """Pairs (query, node) of products >= least that are found. own: the queries' nodes, where they are nodes of this graph."""
        pairs = []
        for i in range(0, len(queries), at_once):
            part = queries[i : i + at_once]
            rows = np.arange(len(part))
            entry = np.full(len(part), self.start)
            for layer in range(len(self.layers) - 1, 0, -1):
                entry = self._search_layer(part, (rows, entry), layer, 4, np.inf)[0]
            entries = (rows, entry) if own is None else (np.concatenate([rows, rows]), np.concatenate([entry, own[i : i + at_once]]))
            _, q, node = self._search_layer(part, entries, 0, beam, least)
            pairs.append((q + i, node))
        return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def compared(x: np.ndarray, queries: np.ndarray, least: float):
    """All pairs (query, node) of products >= least."""
    parts = [np.nonzero(queries[i : i + 256] @ x.T >= least) for i in range(0, len(queries), 256)]
    return np.concatenate([r + 256 * i for i, (r, _) in enumerate(parts)]), np.concatenate([c for _, c in parts])


def audited(graph: Graph, queries: np.ndarray, least: float, beam: int, recall: float, own: np.ndarray | None = None, audit: int = 128):
    """Links of all queries but with themselves, with the beam widened until `audit` of them, evenly chosen, find `recall` of theirs."""
    some = np.unique(np.linspace(0, len(queries) - 1, min(audit, len(queries))).astype(int))
    others = lambda q, n, at: (q, n) if own is None else tuple(y[own[at][q] != n] for y in (q, n))
    wanted = len(others(*compared(graph.x, queries[some], least), some)[0])
    while beam < len(graph.x):
        found = others(*graph.within(queries[some], least, beam, None if own is None else own[some]), some)
        if len(found[0]) >= recall * wanted:
            return others(*graph.within(queries, least, beam, own), np.arange(len(queries)))
        beam *= 2
    return others(*compared(graph.x, queries, least), np.arange(len(queries)))


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) make up a spanning forest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent, out = list(range(len(nodes))), np.zeros(len(a), bool)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (u, v) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist())):
        u, v = root(u), root(v)
        if u != v:
            parent[u] = v
            out[i] = True
    return out


def typed(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))


def nodes_of(vectors: DataFrame) -> DataFrame:
    """Usable vectors, one row per label and components: number, node (least vec_id), copies, label, embedding."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = typed(vectors).where(F.col("label").isNotNull() & F.coalesce(good, F.lit(False)))
    same = v.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    return common.written(same.withColumn("number", F.monotonically_increasing_id()), "nodes")


def shards_of(nodes: DataFrame, shard_size: int, folder: str) -> DataFrame:
    """label, d (length), shards: how many files of graphs each label and length has in folder. nodes: see nodes_of."""
    sizes = nodes.groupBy("label", F.size("embedding").alias("d")).agg(F.ceil(F.count("*") / shard_size).alias("shards"))
    sizes = common.written(sizes, "sizes")
    dealt = nodes.withColumn("d", F.size("embedding")).join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, ["label", "d"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("number"), "shards")).select("label", "d", "shard", "number", "copies", "embedding")

    def build(pdf):
        import pandas as pd

        pdf = pdf.sort_values("number")
        x = np.stack(pdf["embedding"].to_numpy())
        x = x / np.abs(x).max(1, keepdims=True)  # so that no square is out of range
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        graph = Graph(x.astype(np.float32))
        label, d, shard = (int(pdf[c].iloc[0]) for c in ("label", "d", "shard"))
        common.put(folder, f"{label}-{d}-{shard}", pickle.dumps((pdf["number"].to_numpy(), pdf["copies"].to_numpy(), x, graph.layers, graph.start), 5))
        return pd.DataFrame({"nodes": [len(pdf)]})

    common.written(dealt.groupBy("label", "d", "shard").applyInPandas(build, "nodes long"), "built")
    return sizes


def links(sizes: DataFrame, folder: str, least: float, beam: int, recall: float) -> DataFrame:
    """(a, null, linked): vectors that node a is linked to, per search; (a, b, null): a spanning forest of the links of each search."""

    def load(name):
        system, base = common.open_fs(folder)
        with system.open_input_stream(f"{base}/{name}", compression=None) as f:
            return pickle.loads(f.read())

    def search(batches):
        name, held = None, None
        for batch in batches:
            for label, d, asker, shard in zip(*(batch.column(c).to_pylist() for c in ("label", "d", "asker", "shard"))):
                if name != f"{label}-{d}-{shard}":
                    name = f"{label}-{d}-{shard}"
                    held = load(name)
                    graph = Graph.__new__(Graph)
                    graph.x, graph.layers, graph.start = held[2].astype(np.float32), held[3], held[4]
                own, own_copies, y = (load(f"{label}-{d}-{asker}") if asker != shard else held)[:3]
                q, n = audited(graph, y.astype(np.float32), least - 1e-4, beam, recall, np.arange(len(own)) if asker == shard else None)
                numbers, copies = held[:2]
                if asker == shard and len(q):  # each link once, whichever end found it
                    q, n = np.divmod(np.unique(np.minimum(q, n) * len(own) + np.maximum(q, n)), len(own))
                cosine = np.concatenate([np.einsum("ij,ij->i", y[q[i : i + 65536]], held[2][n[i : i + 65536]]) for i in range(0, max(len(q), 1), 65536)])
                q, n = q[cosine >= least], n[cosine >= least]
                a, b = own[q], numbers[n]
                tree = forest(a, b)
                ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                linked = np.bincount(at, np.concatenate([copies[n], own_copies[q]]), len(ids)).astype(np.int64)
                none = pa.nulls(len(ids), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), none, pa.array(linked)], ["a", "b", "linked"])
                yield pa.RecordBatch.from_arrays([pa.array(a[tree], pa.int64()), pa.array(b[tree], pa.int64()), pa.nulls(int(tree.sum()), pa.int64())], ["a", "b", "linked"])

    shard = sizes.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    pairs = shard.withColumn("asker", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shard"))))
    dealt = pairs.repartition(common.partitions(sizes.sparkSession), "label", "d", "shard", F.floor(F.col("asker") / 8)).sortWithinPartitions("label", "d", "shard", "asker")
    return common.written(dealt.select("label", "d", "asker", "shard").mapInArrow(search, FOUND), "links")


def near_vectors(vectors: DataFrame, least: float = 0.93, shard_size: int = 8192, beam: int = 32, recall: float = 0.999) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    nodes = nodes_of(vectors)
    folder = common.shared_folder(vectors.sparkSession, "graphs")
    found = links(shards_of(nodes, shard_size, folder), folder, least, beam, recall)
    counted = found.where("b is null").groupBy(F.col("a").alias("number")).agg(F.sum("linked").alias("linked"))
    joined = components(found.where("b is not null"), "a", "b").withColumnRenamed("node", "number")
    roots = nodes.select("number", "node", "copies").join(joined, "number", "left").withColumn("component", F.coalesce("component", "number"))
    least_id = roots.groupBy("component").agg(F.min("node").alias("component_id"))
    facts = roots.join(least_id, "component").join(counted, "number", "left")
    facts = facts.select("number", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = nodes.select("label", "embedding", "number").join(facts, "number").drop("number")
    out = typed(vectors).join(known, ["label", "embedding"], "left")
    id_ = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), id_)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_vector_dedup(spark, sf_dir):
    return near_vectors(common.table(spark, sf_dir, "embeddings"))
