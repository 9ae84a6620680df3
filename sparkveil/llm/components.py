"""Connected components by alternating stars (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u > v): every neighbour of u is tied to the least of u and its neighbours; the large step
    moves greater neighbours, the small one the others. Hot nodes are a skewed join, never a group held in memory."""
    ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    both = ways.join(least, "u")
    if large:
        out = both.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


#: Edges in a file of the tables between rounds; small tables then cost few tasks.
FILE_EDGES = 250_000


def components(edges: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); a component is named by its least node. No edges, no rows.

    ``settled``, the answer for edges seen before, stands for all of those: a tie from each node to its component is
    enough. The number of rounds grows with the logarithm of the longest path; each round is a table in the shared folder.
    """
    if settled is not None:
        edges = edges.select("u", "v").unionByName(settled.select(F.col("node").alias("u"), F.col("component").alias("v")))
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            break
        mark = new
        now = stored(_star(_star(now, True), False).distinct().coalesce(new[0] // FILE_EDGES + 1), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
