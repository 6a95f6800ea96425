"""Connected components by alternating large and small stars.

Every step is one aggregation and one join on node ids, so no component is gathered in one
task, and a star's centre with many neighbours only costs its partial minimum. The number of
rounds grows with the logarithm of the longest path. A round writes one table, and the table
before is removed. With `bounded`, one task finishes as soon as at most so many edges are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import removed, written_at


def _finished(star: DataFrame) -> DataFrame:
    """The components of a bounded number of edges, by one task."""
    kind = star.schema["u"].dataType.simpleString()

    def join(batches):
        import pandas as pd

        above = {}

        def root(x):
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for pdf in batches:
            for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist()):
                above.setdefault(a, a)
                above.setdefault(b, b)
                a, b = root(a), root(b)
                above[max(a, b)] = min(a, b)
        if above:
            yield pd.DataFrame({"node": list(above), "component": [root(x) for x in above]})

    return star.coalesce(1).mapInPandas(join, f"node {kind}, component {kind}")


def components(edges: DataFrame, u: str = "u", v: str = "v", bounded: int = 0) -> DataFrame:
    """(node, component): the least node of its component, for every node that has an edge to another."""
    star = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    (star, at), before = written_at(star, "edges"), None
    if bounded and star.count() <= bounded:
        return _finished(star)
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, now_at = written_at(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        removed(edges.sparkSession, at)
        star, at = now, now_at
        sign = star.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sign == before or not sign.n:
            break
        if bounded and sign.n <= bounded:
            return _finished(star)
        before = sign
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
