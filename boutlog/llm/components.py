"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a grouped minimum with map-side combination and a join of the links with it. The minima are written
before the join, so that both of its sides are exchanges of their own and adaptive execution can split the links
of a node that has very many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boutlog.session import discard, stored


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Links each neighbour to the least node around: of larger neighbours (both=True), else of smaller ones."""
    wide = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(wide.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
    joined = wide.join(least, "a")
    if both:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
    out = stored(out.where("a <> b").distinct())
    discard(least)
    return out


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the least node reachable) of every node that has a link."""
    now = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    mark = _mark(now)
    while mark[0]:
        large = _star(now, True)
        small = _star(large, False)
        discard(now, large)
        now, before, mark = small, mark, _mark(small)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
