"""Choices in turn without a task per component: rounds of joins and aggregations.

Rows choose in the order of their names, and a choice takes something away from later rows. In each
round every row decides whose choice no undecided earlier row can change; what it takes is
taken from the others. The rules below decide far more rows a round than those that are
first everywhere. Rounds follow the longest chain of choices that truly wait for each other; once
at most `small` edges are left, one task replays these in order, so its size has a bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import removed, written_at

#: Edges that one task may finish.
SMALL = 100_000


def _rounds(edges: DataFrame, decide, finish, small: int) -> DataFrame:
    """All choices. decide(edges) gives (edges with what their rows decide, choices, edges left); finish replays a bounded rest."""
    spark, found = edges.sparkSession, None
    (edges, at), n = written_at(edges, "edges"), None
    while True:
        left = edges.count()
        if left == n:
            raise ValueError("a round decided nothing")
        n = left
        if left <= small:
            break
        told, told_at = written_at(decide[0](edges), "decided")
        chosen = written_at(decide[1](told), "chosen")[0]
        found = chosen if found is None else found.unionByName(chosen)
        edges, after = written_at(decide[2](told, chosen), "edges")
        removed(spark, at)
        removed(spark, told_at)
        at = after
    last = finish(edges)
    return last if found is None else found.unionByName(last)


def sole_places(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(txn_id, group_id): rows in txn_id order, each taking its one free place if it has exactly one. edges: txn_id, group_id, source_kind.

    A place is a group and a source, and one row takes it. Each round:
    * behind the first row that has no other place left, a place is certainly taken: later edges go;
    * a row whose only place has no earlier row takes it;
    * a row without places, or with two that no earlier row wants, takes none.
    """
    place = ("group_id", "source_kind")

    def decided(rows):
        of_row, of_place = W.partitionBy("txn_id"), W.partitionBy(*place)
        told = rows.withColumn("places", F.count("*").over(of_row))
        told = told.withColumn("first", F.min("txn_id").over(of_place)).withColumn("sole", F.min(F.when(F.col("places") == 1, F.col("txn_id"))).over(of_place))
        told = told.withColumn("open", F.col("sole").isNull() | (F.col("txn_id") <= F.col("sole")))
        leads = F.col("open") & (F.col("txn_id") == F.col("first"))
        told = told.withColumn("leads", leads).withColumn("n", F.count_if("open").over(of_row)).withColumn("n_leads", F.count_if("leads").over(of_row))
        takes = F.col("leads") & (F.col("n") == 1)
        over = (F.col("n") == 0) | (F.col("n_leads") >= 2) | ((F.col("n") == 1) & (F.col("n_leads") == 1))
        return told.select("txn_id", *place, "open", takes.alias("takes"), over.alias("over"))

    def chosen(told):
        return told.where("takes").select("txn_id", *place)

    def left(told, took):
        return told.where("open and not over").select("txn_id", *place).join(took.select(*place), list(place), "left_anti")

    def finish(rows):
        def replay(batches):
            import pandas as pd

            own = pd.concat([*batches, pd.DataFrame(columns=["txn_id", *place])])
            taken, out = set(), []
            for txn, mine in own.sort_values("txn_id").groupby("txn_id", sort=True):
                free = [p for p in zip(mine["group_id"], mine["source_kind"]) if p not in taken]
                if len(free) == 1:
                    taken.add(free[0])
                    out.append((txn, *free[0]))
            yield pd.DataFrame(out, columns=["txn_id", *place])

        return rows.coalesce(1).mapInPandas(replay, "txn_id string, group_id string, source_kind string")

    rows = edges.select("txn_id", *place).distinct()
    return _rounds(rows, (decided, chosen, left), finish, small).select("txn_id", "group_id")


def first_of_kinds(pairs: DataFrame, small: int = SMALL) -> DataFrame:
    """(g, o, label): each g in turn takes its first free o of each source_kind, if one of their labels isn't gross; else nothing.

    Each round a g decides if no earlier undecided g wants any of the o that would be its first;
    a g without a label other than gross left takes nothing at once.
    """

    def decided(rows):
        told = rows.withColumn("hope", F.max((F.col("label") != "gross").cast("int")).over(W.partitionBy("g")))
        told = told.withColumn("user", F.min(F.when(F.col("hope") == 1, F.col("g"))).over(W.partitionBy("o")))
        told = told.withColumn("best", F.min("o").over(W.partitionBy("g", "source_kind")))
        told = told.withColumn("waits", F.max(((F.col("o") == F.col("best")) & (F.col("user") < F.col("g"))).cast("int")).over(W.partitionBy("g")))
        picked = (F.col("o") == F.col("best")) & (F.col("hope") == 1) & (F.col("waits") == 0)
        worth = F.max((picked & (F.col("label") != "gross")).cast("int")).over(W.partitionBy("g")) == 1
        return told.withColumn("takes", picked & worth).withColumn("over", (F.col("hope") == 0) | (F.col("waits") == 0)).select(*rows.columns, "takes", "over")

    def chosen(told):
        return told.where("takes").select("g", "o", "label")

    def left(told, took):
        return told.where("not over").select("g", "o", "source_kind", "label").join(took.select("o"), "o", "left_anti").select("g", "o", "source_kind", "label")

    def finish(rows):
        def replay(batches):
            import pandas as pd

            own = pd.concat([*batches, pd.DataFrame(columns=["g", "o", "source_kind", "label"])])
            used, out = set(), []
            for g, mine in own.sort_values(["g", "o"]).groupby("g", sort=True):
                picked = {}
                for o, kind, label in zip(mine["o"], mine["source_kind"], mine["label"]):
                    if o not in used:
                        picked.setdefault(kind, (o, label))
                if any(label != "gross" for _, label in picked.values()):
                    used |= {o for o, _ in picked.values()}
                    out += [(g, o, label) for o, label in picked.values()]
            yield pd.DataFrame(out, columns=["g", "o", "label"])

        return rows.coalesce(1).mapInPandas(replay, "g string, o string, label string")

    return _rounds(pairs.select("g", "o", "source_kind", "label"), (decided, chosen, left), finish, small)
