"""Trees as edge lists: reachability, orphans, missing roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables


def reachable(nodes: DataFrame, roots: list[str]) -> DataFrame:
    """doc_id, path of the nodes under the roots, of any depth; each round joins the frontier with its children."""
    edges = nodes.select(F.col("doc_id").alias("d"), F.col("parent_path").alias("up"), F.col("path").alias("below"))
    frontier = tables.settled(nodes.where(F.col("path").isin(roots)).select("doc_id", "path").distinct(), "roots")
    found = frontier
    while frontier.take(1):
        down = frontier.join(edges, (F.col("doc_id") == F.col("d")) & (F.col("path") == F.col("up"))).select(F.col("d").alias("doc_id"), F.col("below").alias("path")).distinct()
        frontier = tables.settled(down.join(found, ["doc_id", "path"], "left_anti"), "frontier")
        found = found.unionByName(frontier)
    return found


def orphans(nodes: DataFrame, roots: list[str]) -> DataFrame:
    return nodes.join(reachable(nodes, roots), ["doc_id", "path"], "left_anti")


def missing_roots(nodes: DataFrame, required: list[str]) -> DataFrame:
    """doc_id, path of required roots that a document lacks."""
    want = nodes.select("doc_id").distinct().withColumn("path", F.explode(F.array(*[F.lit(r) for r in required])))
    return want.join(nodes.select("doc_id", "path"), ["doc_id", "path"], "left_anti")
