"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import cluster


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of Kiveris et al. (2014): neighbours move to the smallest of a node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hung = both.join(low, "u")
    moved = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return moved.where("u <> v")


def components(edges: DataFrame, folder: str, most: int = 60) -> DataFrame:
    """(u, v): each node of an edge list (u, v) with the smallest node of its component, but for that node itself.

    Every step is written to the folder, so lineage stays short.
    """
    edges = cluster.written(edges.select("u", "v").where("u <> v").distinct(), folder, "step0")
    for k in range(1, most):
        edges = cluster.written(_star(_star(edges, True), False).distinct(), folder, f"step{k}")
        cluster.drop_folder(edges.sparkSession, f"{folder}/step{k - 1}")
        twice = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        chained = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
        if not twice.union(chained).head(1):  # stars already
            return edges
    raise RuntimeError("components did not settle")
