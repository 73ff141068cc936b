"""Connected components of an edge list: large stars and small stars in turn, until every edge points to its smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _with_least(edges: DataFrame) -> DataFrame:
    """u, v, m: m is the least of u and its neighbours.  Sums are made before the shuffle, and a hot u's join is Spark's to split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    small = _with_least(down)
    return small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, component (its smallest node) for every node that has an edge to another; null ends and loops count nothing."""
    now = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct()
    now, before = common.settled(now, "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, now = state, common.settled(_round(now), "edges", rows=2 * state[0])  # a round has no more edges than nodes and edges before it
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
