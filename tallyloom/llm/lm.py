"""Language-model scoring: a causal self-attention model on subword ids, trained in numpy.

The model has one attention head over the last ids, with a bias per distance. Its output is a
group, a class in the group (the most frequent ids have a class each, the others share classes
by frequency) and the id's share of its class, which comes from counts over all training
documents. It learns from every id of all training documents, in rounds: each block of documents
trains a copy of the model, and the copies are averaged, weighted by the windows they learnt
from. A round takes a share of the blocks; small tables are gone over several times. So scores
depend on the input's splits, which make the blocks, not (but for rounding) on the number of
partitions or executors.

Words are counted and encoded once each in a table of distinct words (word_table); base_score
and ids come back from it by position, and training and scoring read these packed ids. Scoring
goes over windows of 2 * stride ids that overlap by stride: the ids of the second half are
scored, so each id once, with at least stride ids before it (padding at the start).

Null or empty text is the end alone. Rows of one doc_id are scored apart; rows without doc_id are
neither held out nor learnt from. Columns other than doc_id and text are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens, word_table

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
END = 49407
SIZE = 49408


def in_training(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 10 != 0 if doc_id is not None else False


def counted_ids(path: str):
    """For word_table.answered: each word's count, and the ids of its lower-case form (special ids written in capitals count as such)."""

    def facts(words, counts):
        encoder = tokens.encoder(path)
        plain = [w for w in words if b"<|" not in w]
        ids = dict(zip(plain, encoder.distinct(plain)))
        ids |= {w: encoder.whole(w.decode("utf-8", "replace")).tobytes() for w in words if b"<|" in w}
        own = [ids[w] for w in words]
        return [counts], np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), np.int64, len(own)) // 4

    return facts


def summed(values, flat, runs, counts) -> bytes:
    """Per bucket: training tokens, distinct training words, and how often each id is in the training documents."""
    n = np.bincount(flat.astype(np.int64), np.repeat(counts, runs).astype(np.float64), 1).astype(np.int64)
    at = np.flatnonzero(n)
    return word_table.packed(np.array([counts.sum(), (counts > 0).sum()], "<i8"), at.astype("<i8"), n[at].astype("<i8"))


def totals(answers: DataFrame, ends: int) -> tuple[int, int, np.ndarray]:
    """Training tokens, distinct tokens and counts of ids, summed over the buckets in Spark. ends: number of training documents."""

    def unpack(batches):
        for batch in batches:
            for fact in batch.column("fact").to_pylist():
                (n, distinct), at, counts = word_table.unpacked(fact)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], at])), pa.array(np.concatenate([[n, distinct], counts]))], ["id", "n"])

    rows = answers.where("span = -1").select("fact").mapInArrow(unpack, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = {r.id: r.n for r in rows.collect()}  # at most one row per id of the vocabulary
    total, distinct = found.pop(-1, 0), found.pop(-2, 0)
    counts = np.zeros(SIZE, np.int64)
    counts[list(found)] = list(found.values())
    counts[END] += ends
    return total + ends, distinct + (ends > 0), counts


class Model:
    """Parameters and passes. inputs: rows of ids as numbers of embeddings; classes to predict, class // members is the group."""

    def __init__(self, counts: np.ndarray, groups: int = 12, members: int = 32, tails: int = 32, embedded: int = 1024, width: int = 16, stride: int = 16, seed: int = 7):
        rng, order = np.random.default_rng(seed), np.argsort(-counts, kind="stable")
        self.stride, self.width, self.groups, self.members = stride, width, groups, members
        self.classes = groups * members
        top = self.classes - tails
        self.of = np.empty(SIZE, np.uint16)
        self.of[order[:top]] = np.arange(top)
        rest = order[top:]
        self.of[rest] = top + np.minimum((np.log2(np.arange(len(rest)) + 32) - 5) / (np.log2(len(rest) + 32) - 5) * tails, tails - 1).astype(int)
        smooth = counts + 0.1
        class_n = np.bincount(self.of, smooth, self.classes)
        self.share = np.log(smooth / class_n[self.of]).astype(np.float32)
        self.row = np.full(SIZE, embedded, np.int64)
        self.row[order[embedded:]] = embedded + 1 + self.of[order[embedded:]] % tails
        self.row[order[:embedded]] = np.arange(embedded) + 1
        gap = np.arange(stride, 2 * stride)[:, None] - np.arange(2 * stride)
        self.gap = np.where(gap < 0, 2 * stride, gap)  # 2 * stride: not seen
        self.sides = np.repeat(np.eye(2, dtype=np.float32), (members, groups), 1)  # the columns of members, and of groups
        self.cells = np.arange((embedded + 1 + tails) * width).reshape(-1, width)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        group_n = class_n.reshape(groups, members).sum(1)
        self.p = {"e": draw(embedded + 1 + tails, width), "q": draw(width, width), "k": draw(width, width), "v": draw(width, width), "r": draw(2 * stride), "g": draw(2 * width, groups), "gb": np.log(group_n / group_n.sum()).astype(np.float32), "o": draw(groups, 2 * width, members), "ob": np.log(class_n.reshape(groups, members) / group_n[:, None]).astype(np.float32)}

    def laid(self, ids: np.ndarray, ends: np.ndarray):
        """Texts end to end, cut into rows of stride ids behind a row of padding each: inputs (embedding rows), classes to predict, which of these are ids."""
        s, sizes = self.stride, np.diff(ends)
        rows = -(-sizes // s) + 1
        first = np.cumsum(rows) - rows
        edges = np.zeros(rows.sum() * s + 1, np.int8)
        np.add.at(edges, (first + 1) * s, 1)
        np.subtract.at(edges, (first + 1) * s + sizes, 1)
        valid = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
        inputs, goal = np.zeros(len(valid) + 1, np.int64), np.zeros(len(valid), self.of.dtype)
        inputs[1:][valid], goal[valid] = self.row.take(ids), self.of.take(ids)
        inputs = inputs[:-1].reshape(-1, s)
        inputs[first] = 0
        return inputs, goal.reshape(-1, s), valid.reshape(-1, s)

    def seen_as(self):
        """Of every embedding row what attention takes from it: query, key, value, and the row itself."""
        p, w, e = self.p, self.width, self.p["e"]
        table = np.empty((len(e), 4 * w), e.dtype)
        np.matmul(e, np.concatenate([p["q"] * e.dtype.type(1 / math.sqrt(w)), p["k"], p["v"]], 1), out=table[:, : 3 * w])
        table[:, 3 * w :] = e
        return table

    def forward(self, inputs: np.ndarray):
        """Embedding and attention output (as many rows as ids behind the first stride of each run; 2 x width), and what the backward pass needs.

        inputs: runs of ids; each stride of them sees itself and the stride before it.
        """
        rows, kept = self.attended(inputs, self.seen_as())
        return rows[:, :-1], kept

    def attended(self, inputs: np.ndarray, table: np.ndarray, small: bool = False):
        """As `forward`, with a one behind each row for the biases. table: `seen_as` of the parameters; small: no logit is beyond 60."""
        p, s, w = self.p, self.stride, self.width
        n, size = inputs.shape
        made = table.take(inputs, 0)
        own = made.reshape(n, size // s, s, -1)[:, 1:]
        q, k, v = own[..., :w], self.seen(made, w), self.seen(made, 2 * w)
        a = q @ k.swapaxes(2, 3)
        if not small:
            a.clip(-60, 60, out=a)
        np.exp(a, out=a)
        near = np.zeros(2 * s + 1, made.dtype)
        np.exp(p["r"], out=near[:-1])
        a *= near.take(self.gap)
        rows = a.reshape(-1, 2 * s)
        rows *= (1 / (rows @ np.ones(2 * s, a.dtype)))[:, None]
        h = np.empty((n, size // s - 1, s, 2 * w + 1), made.dtype)
        h[..., :w] = own[..., 3 * w :]
        np.matmul(a, v, out=h[..., w:-1])
        h[..., -1] = 1
        return h.reshape(-1, 2 * w + 1), (q, k, v, a)

    def joined(self):
        """Of each group the weights of its members, and behind them those of all groups, for the rows of `attended`."""
        p, w, m = self.p, 2 * self.width, self.members
        out = np.empty((self.groups, w + 1, m + self.groups), p["o"].dtype)
        out[:, :w, :m], out[:, w, :m], out[:, :w, m:], out[:, w, m:] = p["o"], p["ob"], p["g"], p["gb"]
        return out

    def bounded(self, table: np.ndarray, weights: np.ndarray) -> bool:
        """Whether no logit can be beyond 60, by the lengths of the vectors that make them."""
        w, most = self.width, lambda x, axis: math.sqrt(np.square(x).sum(axis).max())
        q, k, v, e = (most(table[:, i * w : (i + 1) * w], 1) for i in range(4))
        of_e, of_v = most(weights[:, :w], 1), most(weights[:, w:-1], 1)
        return q * k <= 59 and e * of_e + v * of_v + np.abs(weights[:, -1]).max() <= 59

    def seen(self, made: np.ndarray, at: int) -> np.ndarray:
        """A view of width columns from `at` of runs x ids x columns as runs x strides x the 2 stride ids that each sees."""
        s, (n, size, _) = self.stride, made.shape
        run, row, one = made.strides
        return np.ndarray((n, size // s - 1, 2 * s, self.width), made.dtype, made, at * one, (run, s * row, row, one))

    def seen_summed(self, parts: np.ndarray, out: np.ndarray) -> None:
        """The reverse of `seen`: what each stride adds to the ids that it sees, per id."""
        s = self.stride
        out[:, 0], out[:, -1] = parts[:, 0, :s], parts[:, -1, s:]
        np.add(parts[:, :-1, s:], parts[:, 1:, :s], out=out[:, 1:-1])

    def by_group(self, goal: np.ndarray, valid: np.ndarray):
        """The valid positions in the order of their classes' groups, (group, first, end) of each group's run of them, and the other positions."""
        key = np.where(valid, goal // goal.dtype.type(self.members), goal.dtype.type(self.groups)).astype(np.min_scalar_type(self.groups))
        order = np.argsort(key, kind="stable")
        cuts = key[order].searchsorted(np.arange(self.groups + 1, dtype=key.dtype)).tolist()
        return order[: cuts[-1]], [(g, a, b) for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a], order[cuts[-1] :]

    def odds(self, h: np.ndarray, spans, weights: np.ndarray, small: bool = False):
        """Exponentials of the members of each row's own group, and of the groups behind them; logits count as 60 at most, -60 at least."""
        z = np.empty((len(h), weights.shape[2]), h.dtype)
        for g, a, b in spans:
            np.matmul(h[a:b], weights[g], out=z[a:b])
        if not small:
            z.clip(-60, 60, out=z)
        return np.exp(z, out=z)

    def sums(self, z: np.ndarray):
        """Of each row of `odds` the sum of members, and of groups."""
        m, one = self.members, np.ones(max(self.members, self.groups), z.dtype)
        return z[:, :m] @ one[:m], z[:, m:] @ one[: self.groups]

    def log_probabilities(self, ids: np.ndarray, ends: np.ndarray, at_once: int = 256) -> np.ndarray:
        """Natural-log probability of every id of some texts."""
        inputs, goal, valid = self.laid(ids, ends)
        value, table, weights = np.zeros(valid.shape), self.seen_as(), self.joined()
        small = self.bounded(table, weights)
        inputs = np.concatenate([np.zeros((1, self.stride), np.int64), inputs])
        for i in range(0, len(goal), at_once):
            own = goal[i : i + at_once].reshape(-1)
            order, spans, _ = self.by_group(own, valid[i : i + at_once].reshape(-1))
            h = self.attended(inputs[i : i + at_once + 1].reshape(1, -1), table, small)[0].take(order, 0)
            z, at = self.odds(h, spans, weights, small), np.arange(len(order)) * weights.shape[2]
            group, member = np.divmod(own[order], own.dtype.type(self.members))
            found = z.reshape(-1).take(at + member).astype(float) * z.reshape(-1).take(at + self.members + group)
            members, groups = self.sums(z)
            value[i : i + at_once].reshape(-1)[order] = np.log(found / (members.astype(float) * groups))
        return value[valid] + self.share[ids]

    def gradients(self, inputs: np.ndarray, goal: np.ndarray, valid: np.ndarray) -> dict:
        """Of the mean loss over the valid positions of some runs. goal: classes of the ids behind each run's first stride."""
        p, s, w, most = self.p, self.stride, self.width, self.members
        all_h, (q, k, v, a) = self.attended(inputs, self.seen_as())
        n, rows = len(inputs), inputs.shape[1] // s
        order, spans, rest = self.by_group(goal.reshape(-1), valid.reshape(-1))
        h, goal = all_h.take(order, 0), goal.reshape(-1)[order]
        each = h.dtype.type(1 / max(1, len(order)))
        weights = self.joined()
        z = self.odds(h, spans, weights)
        z *= (each / np.stack(self.sums(z))).T @ self.sides.astype(h.dtype, copy=False)
        z.reshape(-1)[np.arange(len(goal)) * z.shape[1] + goal % goal.dtype.type(most)] -= each
        to, of = np.zeros_like(weights), np.empty((len(h), 2 * w), h.dtype)
        for g, i, j in spans:
            z[i:j, most + g] -= each
            np.matmul(h[i:j].T, z[i:j], out=to[g])
            np.matmul(z[i:j], weights[g, :-1].T, out=of[i:j])
        to_groups = to[:, :, most:].sum(0)
        found = {"g": to_groups[:-1], "gb": to_groups[-1], "o": to[:, :-1, :most], "ob": to[:, -1, :most]}
        # of each id: what its query, key and value get, and the row of its output's slopes
        d = np.empty((n, rows, s, 5 * w), h.dtype)
        d[:, 0, :, :w], d[:, 0, :, 3 * w :] = 0, 0
        flat, at = d.reshape(-1, 5 * w)[:, 3 * w :], np.arange(n * rows * s).reshape(n, rows * s)[:, s:].reshape(-1)
        flat[at.take(order)], flat[at.take(rest)] = of, 0
        dh = d[:, 1:, :, 4 * w :]
        # of the attention's logits: weight * do v' less the weight's share of their sum
        ds = dh @ v.swapaxes(2, 3)
        ds *= a
        flat, taken = ds.reshape(-1, 2 * s), a.reshape(-1, 2 * s)
        flat -= taken * (flat @ np.ones(2 * s, h.dtype))[:, None]
        found["r"] = np.bincount(self.gap.reshape(-1), np.ones(n * (rows - 1), h.dtype) @ ds.reshape(-1, 2 * s * s))[:-1].astype(np.float32)
        # what each stride adds to its own ids' queries, and to the keys and values that it sees
        parts = np.empty((n, rows - 1, 2 * s, 2 * w), h.dtype)
        np.matmul(ds, k, out=d[:, 1:, :, :w])
        np.matmul(ds.swapaxes(2, 3), q, out=parts[..., :w])
        np.matmul(a.swapaxes(2, 3), dh, out=parts[..., w:])
        self.seen_summed(parts, d[..., w : 3 * w])
        d, scale = d.reshape(n, -1, 5 * w), h.dtype.type(1 / math.sqrt(w))
        both = (p["e"].take(inputs, 0).swapaxes(1, 2) @ d[..., : 3 * w]).sum(0)
        found["q"], found["k"], found["v"] = both[:, :w] * scale, both[:, w : 2 * w], both[:, 2 * w :]
        dx = d[..., : 4 * w] @ np.concatenate([p["q"].T * scale, p["k"].T, p["v"].T, np.eye(w, dtype=h.dtype)])
        found["e"] = np.zeros_like(p["e"])
        np.add.at(found["e"].reshape(-1), self.cells.take(inputs.reshape(-1), 0).reshape(-1), dx.reshape(-1))
        return found

    def train(self, pieces, batch: int = 96, rate: float = 0.01, seed: int = 3, together: int = 8) -> int:
        """Learns from all windows of each piece (ids, ends), runs of `together` of them in mixed order; the number of windows."""
        rng, step, seen = np.random.default_rng(seed), 0, 0
        names, shapes = list(self.p), [x.shape for x in self.p.values()]
        flat = np.concatenate([x.reshape(-1) for x in self.p.values()])
        m, u, t = (np.zeros_like(flat) for _ in range(3))
        self.p = {k: x.reshape(shape) for k, x, shape in zip(names, np.split(flat, np.cumsum([math.prod(x) for x in shapes])[:-1]), shapes)}
        size = min(together, batch)
        for ids, ends in pieces:
            if not len(ids):
                continue
            inputs, goal, valid = self.laid(ids, ends)
            windows = len(inputs) - (len(ends) - 1)
            seen += windows
            rest = -len(inputs) % size
            inputs, goal, valid = np.pad(inputs, ((1, rest), (0, 0))), np.pad(goal, ((0, rest), (0, 0))), np.pad(valid, ((0, rest), (0, 0)))
            runs = len(goal) // size
            goal, valid = goal.reshape(runs, -1), valid.reshape(runs, -1)
            for pick in np.array_split(rng.permutation(runs), min(runs, max(1, round(windows / batch)))):
                g = self.gradients(inputs[pick[:, None] * size + np.arange(size + 1)].reshape(len(pick), -1), goal[pick], valid[pick])
                g, step = np.concatenate([g[k].reshape(-1) for k in names]), step + 1
                m *= np.float32(0.9)  # the means of slopes and of their squares, times 10 and 100
                m += g
                g *= g
                u *= np.float32(0.99)
                u += g
                root = math.sqrt(1 - 0.99**step)
                np.sqrt(u, out=t)
                t += np.float32(1e-7 * root)
                np.divide(m, t, out=t)
                t *= np.float32(rate * min(1, step / 50) / (1 - 0.9**step) * root)
                flat -= t
        return seen


def blocks_of(docs: DataFrame, answers: DataFrame, base) -> DataFrame:
    """As `blocks_from`, with the blocks coded by another pass over docs."""
    return blocks_from(word_table.coded_rows(docs, common.word_codes, words=False), answers, base)


def blocks_from(coded: DataFrame, answers: DataFrame, base) -> DataFrame:
    """block, data: the packed doc_ids, ends, ids (an end after each text), base scores, words and known words of each block."""

    def finish(number, docs, facts, at, offsets):
        counts, sizes, flat = facts if facts else (np.zeros(0, np.uint16),) * 3
        sizes = sizes.astype(np.int64)
        own, words = sizes[at], np.diff(offsets)
        stops = np.concatenate([[0], np.cumsum(own)])[offsets] + np.arange(len(offsets))
        ids = np.full(stops[-1], END, np.promote_types(flat.dtype, np.uint16))
        keep = np.ones(len(ids), bool)
        keep[stops[1:] - 1] = False
        ids[keep] = word_table.runs_at(flat, sizes, at)
        known = np.concatenate([[0], np.cumsum((counts > 0)[at])])[offsets]
        sums = lambda x: np.array([x[a:b].sum() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
        data = word_table.packed(np.array([d or 0 for d in docs], "<i8"), np.array([d is not None for d in docs], "<u1"), word_table.smallest(stops), word_table.smallest(ids), sums(base(counts.astype(np.int64))[at]).astype("<f8"), words.astype("<i8"), np.diff(known).astype("<i8"))
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([data], pa.binary())], ["block", "data"])

    return word_table.joined(coded, answers, finish, "block long, data binary")


def documents_of(data):
    """doc_ids, ends, ids, base scores, words and known words of a packed block."""
    numbers, valid, ends, ids, *rest = word_table.unpacked(data)
    return [d if v else None for d, v in zip(numbers.tolist(), valid.tolist())], ends.astype(np.int64), ids, *rest


def runs(ids: np.ndarray, ends: np.ndarray, at_once: int = 1 << 18):
    """Cuts texts end to end into runs of texts of about at_once ids: (first text, last, ids, ends)."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + at_once, "right")) - 1)
        yield at, to, ids[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def one_round(blocks: DataFrame, model: Model, batch: int, rate: float, again: int = 1, piece: int = 4096) -> tuple[Model, int]:
    """The average of the copies that blocks train, and the windows learnt from.

    Copies are cut into pieces that are added up in Spark, so the driver gets one model.
    """
    import copy

    sent = blocks.sparkSession.sparkContext.broadcast(model)
    names = list(model.p)

    def train(batches):
        from pyspark import TaskContext

        def texts(data):
            docs, ends, ids, *_ = documents_of(data)
            use = np.array([in_training(d) for d in docs], bool)
            own = ids[np.repeat(use, np.diff(ends))]
            for _, _, part, stops in runs(own, np.concatenate([[0], np.cumsum(np.diff(ends)[use])])):
                yield part, stops

        flat, seen = 0.0, 0
        for b in batches:
            for data in b.column("data").to_pylist():
                own, pieces = copy.deepcopy(sent.value), texts(data)
                n = own.train(list(pieces) * again if again > 1 else pieces, batch, rate)
                if n:
                    flat, seen = flat + np.concatenate([own.p[k].reshape(-1) for k in names]).astype("<f8") * n, seen + n
        if seen:
            cut = [flat[i : i + piece].tobytes() for i in range(0, len(flat), piece)]
            n = len(cut)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)), pa.array(np.full(n, seen)), pa.array(cut, pa.binary())], ["piece", "part", "seen", "values"])

    def add(batches):
        total, seen = {}, {}
        for b in batches:
            for i, n, data in zip(*(b.column(c).to_pylist() for c in ("piece", "seen", "values"))):
                total[i] = total.get(i, 0) + np.frombuffer(data, "<f8")
                seen[i] = seen.get(i, 0) + n
        if total:
            yield pa.RecordBatch.from_pydict({"piece": pa.array(list(total), pa.int32()), "seen": pa.array(list(seen.values()), pa.int64()), "values": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    copies = blocks.select("data").mapInArrow(train, "piece int, part int, seen long, values binary")
    summed = copies.repartition(common.partitions(blocks.sparkSession), "piece").sortWithinPartitions("piece", "part")
    found = sorted(summed.mapInArrow(add, "piece int, seen long, values binary").collect(), key=lambda r: r.piece)
    if not found:
        return model, 0
    flat = np.concatenate([np.frombuffer(bytes(r["values"]), "<f8") for r in found]) / found[0].seen
    ends = np.cumsum([model.p[n].size for n in names])
    model.p = {n: x.reshape(model.p[n].shape).astype(np.float32) for n, x in zip(names, np.split(flat, ends[:-1]))}
    return model, found[0].seen


def fit(blocks: DataFrame, counts: np.ndarray, batch: int, steps: int, rounds: int = 4, rate: float = 0.01) -> tuple[Model, int]:
    """A model of all training documents, and the windows learnt from (a window as often as it was gone over).

    Fewer ids than make `steps` steps of `batch` windows are gone over until they do.
    """
    model, seen = Model(counts), 0
    if not counts.sum():
        return model, 0
    passes = math.ceil(steps * batch * model.stride / counts.sum())
    shares, again = (1, -(-passes // rounds)) if passes >= rounds else (rounds, max(1, passes))
    for r in range(rounds):
        own = blocks.where(F.pmod(F.xxhash64("block"), F.lit(shares)) == r) if shares > 1 else blocks
        model, n = one_round(own, model, batch, rate * (1 - 0.9 * r / max(1, rounds - 1)), again)
        seen += n
    return model, seen


def score(docs: DataFrame, path: str, batch: int = 192, steps: int = 750) -> DataFrame:
    """The rows of SCHEMA for every row of docs. batch, steps: windows in a step, and the fewest steps of the training."""
    coded = common.written(word_table.coded_rows(docs, common.word_codes, in_training), "coded")
    answers = common.written(word_table.answered(word_table.words_of(coded), counted_ids(path), summed), "words")
    ends = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0).count()
    total, distinct, counts = totals(answers, ends)
    least = total + 0.1 * (distinct + 1)
    blocks = common.written(blocks_from(coded, answers.where("span >= 0"), lambda c: np.log10((c + 0.1) / least)), "ids")
    model = docs.sparkSession.sparkContext.broadcast(fit(blocks, counts, batch, steps)[0])
    end_value = math.log10((ends + 0.1) / least)

    def scored(batches):
        for b in batches:
            for data in b.column("data").to_pylist():
                docs, ends_, ids, base, n, known = documents_of(data)
                value = np.concatenate([np.add.reduceat(model.value.log_probabilities(part, stops), stops[:-1]) for _, _, part, stops in runs(ids, ends_)]) / math.log(10)
                held = [d is not None and not in_training(d) for d in docs]
                arrays = [pa.array(docs, pa.int64()), pa.array(held), pa.array(n + 1), pa.array(known + int(ends > 0)), pa.array(np.full(len(n), total)), pa.array(base + end_value), pa.array(value)]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SCHEMA.split(", ")])

    return blocks.select("data").mapInArrow(scored, SCHEMA)


def op8_lm(spark, sf_dir):
    return score(common.table(spark, sf_dir, "documents"), tokens.vocabulary_path())
