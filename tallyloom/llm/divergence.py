"""Source divergence audit by systolic rotation.

Every (lang, source) group has a smoothed share p of each term that its lang keeps. The sum of
absolute differences of p tells how far two sources of a lang are apart, and the terms that a group
has above its lang's share q tell why.

Counts of (lang, source, term) are combined in the tasks before their shuffle, so a source with a
third of all rows sends one row per term and task. The kept terms of a lang are numbered in shards of
at most about `shard` terms; a group's counts in one shard are its vector there. Groups are dealt
into teams, and the compressed vectors of a team in a shard are one packet, of a size that is
bounded by the two parameters. Packets stay in their partition; in the rounds of a round-robin
tournament the peers' packets circulate, and each meeting evaluates both directions. The packet
of the whole lang visits everyone once, and a heap of the best terms per group and shard leaves
the task. Sums over shards and the merge of the heaps are ordinary aggregations.

All arithmetic is exact: shares are worked out by long division in steps of 1,000, which 64 bits
hold for groups of fewer than 9 * 10^15 terms.

Null lang, source and text count as ''. Every row is a document, repeated ones too. A group
without terms has shares of count 0. A lang that keeps no term gives pairs of value 0. Columns
other than lang, source and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .word_table import packed, smallest, unpacked

UNIT, EXTRA = 1_000_000_000, 5
MARK = -1  # the number of the row that brings a group's total to a shard

COUNTS = "lang string, source string, term string, n long, df long"


def group_counts(docs: DataFrame, at_once: int = 16 << 20) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents) of every term of every group."""
    table = common.term_table(digits=False)

    def count(batches):
        for batch in batches:
            for a, b in common.slices(batch.column("text"), at_once):
                words, at, offsets = common.word_codes(common.translated(batch.column("text")[a:b], table))
                if not words:
                    continue
                pairs = pa.StructArray.from_arrays([batch.column("lang")[a:b], batch.column("source")[a:b]], ["lang", "source"])
                names = pc.dictionary_encode(pc.binary_join_element_wise(pc.cast(pc.binary_length(pairs.field(0)), pa.string()), pairs.field(0), pairs.field(1), "/"))
                group = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.full(len(names.dictionary), b - a, np.int64)
                np.minimum.at(first, group, np.arange(b - a))
                doc = np.repeat(np.arange(b - a), np.diff(offsets))
                in_doc, tf = np.unique(doc * len(words) + at, return_counts=True)
                key, own, df = np.unique(group[in_doc // len(words)] * len(words) + in_doc % len(words), return_inverse=True, return_counts=True)
                of = pa.array(first[key // len(words)])
                terms = pa.array(words, pa.binary()).cast(pa.string()).take(pa.array(key % len(words)))
                n = np.bincount(own, tf, len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pairs.field(0).take(of), pairs.field(1).take(of), terms, pa.array(n), pa.array(df.astype(np.int64))], ["lang", "source", "term", "n", "df"])

    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return rows.mapInArrow(count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + EXTRA) / (total + EXTRA * terms)), exact."""
    rest, whole, out = counts.astype(np.int64) + EXTRA, total + EXTRA * terms, np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def vocabulary(counts: DataFrame, least_docs: int, shard: int) -> DataFrame:
    """lang, term, total, shard, no (place in the shard, in the terms' order), terms (of the lang), shards (of the lang)."""
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df")).where(F.col("df") >= least_docs).drop("df")
    kept = common.written(kept, "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms")).withColumn("shards", F.ceil(F.col("terms") / shard))
    dealt = kept.join(sizes, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), "shards").cast("int"))
    no = F.row_number().over(W.partitionBy("lang", "shard").orderBy("term")) - 1
    return common.written(dealt.withColumn("no", no), "vocabulary")


def teams_of(docs: DataFrame, counts: DataFrame, words: DataFrame, team: int) -> DataFrame:
    """lang, source, team, total (terms of the group), terms and shards of its lang: every group that occurs."""
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    totals = counts.join(words.select("lang", "term"), ["lang", "term"], "left_semi").groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = words.select("lang", "terms", "shards").distinct()
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    rows = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    rows = rows.select("lang", "source", F.floor(number / team).cast("int").alias("team"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("shards", F.lit(1)).alias("shards"))
    return common.written(rows, "groups")


MET = "lang string, source string, item string, value long"
PACKET = "lang string, shard int, team int, terms long, width int, sources array<string>, totals array<long>, vectors binary"


def packets(rows: DataFrame) -> DataFrame:
    """One packet per lang, shard and team. rows: lang, shard, team, terms, width, source, no, n; no is MARK on the row with the group's total."""

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by([("source", "ascending"), ("no", "ascending")])
        no, n = part["no"].to_numpy(), part["n"].to_numpy()
        marks = np.flatnonzero(no == MARK)
        sizes = np.diff(np.append(marks, len(no))) - 1
        own = no != MARK
        sources, first = part["source"].take(pa.array(marks)).to_pylist(), part.slice(0, 1)
        return pa.table({
            "lang": first["lang"], "shard": first["shard"], "team": first["team"], "terms": first["terms"], "width": first["width"],
            "sources": pa.array([sources], pa.list_(pa.string())), "totals": pa.array([n[marks].tolist()], pa.list_(pa.int64())),
            "vectors": pa.array([packed(smallest(sizes), smallest(no[own]), smallest(n[own]))], pa.binary()),
        })

    return rows.groupBy("lang", "shard", "team").applyInArrow(pack, PACKET)


def dense(packet: dict) -> tuple[np.ndarray, np.ndarray]:
    """Shares and counts of a packet's groups: one row for each group, one column for each term of the shard."""
    sizes, no, n = unpacked(packet["vectors"])
    counts = np.zeros((len(packet["sources"]), packet["width"]), np.int64)
    counts[np.repeat(np.arange(len(sizes)), sizes.astype(np.int64)), no.astype(np.int64)] = n
    out = np.empty_like(counts)
    for i, total in enumerate(packet["totals"]):
        if packet["width"]:
            out[i] = shares(counts[i], total, packet["terms"])
    return out, counts


def each_row(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def meet(batches):
    """(lang, source, item, value) in both directions of the pairs between two packets, or within one that meets itself."""
    for row in each_row(batches):
        host = {k: row[k] for k in ("sources", "totals", "vectors", "width", "terms")}
        guest = host | {k: row[f"guest_{k}"] for k in ("sources", "totals", "vectors")}
        p, alone = dense(host)[0], row["guest"] == row["team"]
        q = p if alone else dense(guest)[0]
        source, item, value = [], [], []
        for i, name in enumerate(host["sources"]):
            away = np.abs(q - p[i]).sum(axis=1)
            for j, other in enumerate(guest["sources"]):
                if not alone or i < j:
                    source += [name, other]
                    item += [other, name]
                    value += [int(away[j])] * 2
        if source:
            yield pa.RecordBatch.from_pydict({"lang": [row["lang"]] * len(source), "source": source, "item": item, "value": pa.array(value, pa.int64())})


def rivals(residents: DataFrame, at_once: int = 16) -> DataFrame:
    """lang, source, item, value: the difference of every two groups of a lang, from all rounds of the tournament.

    With an odd number of teams one pauses each round. Round r brings team t to (r - t) mod (teams - 1);
    the last team meets the one that this rule brings to itself. `at_once` rounds are one job.
    """
    teams = residents.groupBy("lang").agg((F.max("team") + 1).alias("n"))
    rounds = teams.select("lang", (F.col("n") + F.col("n") % 2 - 1).cast("int").alias("rounds"))
    most = rounds.agg(F.max("rounds")).first()[0] or 0
    names = ("sources", "totals", "vectors")
    found = []
    for start in range(0, most, at_once):
        peers = residents.join(F.broadcast(rounds), "lang").withColumn("round", F.explode(F.sequence(F.lit(start), F.lit(min(start + at_once, most) - 1)))).where("round < rounds")
        last, rule = F.col("team") == F.col("rounds"), F.pmod(F.col("round") - F.col("team"), "rounds").cast("int")
        half = F.when(F.col("round") % 2 == 0, F.floor(F.col("round") / 2)).otherwise(F.floor((F.col("round") + F.col("rounds")) / 2)).cast("int")
        seat = F.when(last, half).when(rule == F.col("team"), F.col("rounds")).otherwise(rule)
        peers = peers.withColumn("seat", seat).where("team > seat")
        if start == 0:  # before the first round everyone meets within the team
            peers = peers.unionByName(residents.withColumns({"seat": F.col("team"), "round": F.lit(-1), "rounds": F.lit(0)}))
        guests = peers.select("lang", "shard", F.col("seat").alias("team"), F.col("team").alias("guest"), *(F.col(c).alias(f"guest_{c}") for c in names))
        met = residents.join(guests, ["lang", "shard", "team"])
        found.append(common.written(met.mapInArrow(meet, MET), "met"))
    rows = residents.sparkSession.createDataFrame([], MET)
    for more in found:
        rows = rows.unionByName(more)
    return rows.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def telling(residents: DataFrame, whole: DataFrame, top: int) -> DataFrame:
    """lang, source, shard, no, value: the `top` terms of each group and shard whose share is most above the lang's."""

    def rank(batches):
        for row in each_row(batches):
            p, counts = dense(row)
            q = dense(row | {c: row[f"lang_{c}"] for c in ("sources", "totals", "vectors")})[0][0]
            for i, source in enumerate(row["sources"]):
                at = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                above = (p[i] - q)[at]
                best = heapq.nsmallest(top, zip((-above).tolist(), at.tolist()))
                if best:
                    value, no = zip(*best)
                    yield pa.RecordBatch.from_pydict({"lang": [row["lang"]] * len(no), "source": [source] * len(no), "shard": pa.array([row["shard"]] * len(no), pa.int32()), "no": pa.array(no, pa.int32()), "value": pa.array([-v for v in value], pa.int64())})

    visit = whole.select("lang", "shard", *(F.col(c).alias(f"lang_{c}") for c in ("sources", "totals", "vectors")))
    return residents.join(visit, ["lang", "shard"]).mapInArrow(rank, "lang string, source string, shard int, no int, value long")


def divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, team: int = 8, shard: int = 65_536) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank of every group of docs."""
    spark = docs.sparkSession
    counts = common.written(group_counts(docs), "counts")
    words = vocabulary(counts, least_docs, shard)
    groups = teams_of(docs, counts, words, team)
    widths = words.groupBy("lang", "shard").agg(F.count("*").cast("int").alias("width"))
    width = F.coalesce("width", F.lit(0)).alias("width")

    own = ("lang", "shard", "team", "terms", "source", "no", "n")
    vectors = counts.join(words.select("lang", "term", "shard", "no"), ["lang", "term"]).join(groups.select("lang", "source", "team", "terms"), ["lang", "source"])
    marks = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards").cast("int") - 1))).withColumns({"no": F.lit(MARK), "n": F.col("total")})
    rows = vectors.select(*own).unionByName(marks.select(*own))
    sums = words.groupBy("lang", "terms").agg(F.sum("total").alias("n")).join(widths.select("lang", "shard"), "lang")
    langs = words.select("lang", "shard", "terms", "no", F.col("total").alias("n")).unionByName(sums.select("lang", "shard", "terms", F.lit(MARK).alias("no"), "n"))
    langs = langs.select("lang", "shard", F.lit(-1).alias("team"), "terms", F.lit("").alias("source"), "no", "n")
    sized = lambda df: df.join(widths, ["lang", "shard"], "left").withColumn("width", width)

    standing = common.written(packets(sized(rows)), "packets")
    residents = standing.repartition(common.partitions(spark), "lang", "shard", "team").persist(StorageLevel.DISK_ONLY)
    pairs = common.written(rivals(residents), "pairs")
    found = common.written(telling(residents, packets(sized(langs)), top), "terms")
    residents.unpersist()

    terms = found.join(words.select("lang", "shard", "no", F.col("term").alias("item")), ["lang", "shard", "no"])
    rows = pairs.withColumn("part", F.lit("pair")).unionByName(terms.select("lang", "source", "item", "value").withColumn("part", F.lit("term")))
    place = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = rows.withColumn("rank", place).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark, sf_dir):
    return divergence(common.table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS df FROM (SELECT i, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(df) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total) AS total FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
own AS MATERIALIZED (SELECT c.lang, c.source, c.term, c.n FROM c JOIN k USING (lang, term)),
size AS (SELECT lang, source, sum(n) AS n FROM own GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(own.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(own.n, 0) + 5)) // (coalesce(size.n, 0) + 5 * v.v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN size USING (lang, source) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = k.term),
q AS (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (k.total + 5)) // (v.total + 5 * v.v) AS q FROM k JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every) WHERE part = 'pair' OR rank <= 50
"""
