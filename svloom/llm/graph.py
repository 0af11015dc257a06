"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svloom.llm.common import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("n"), "m")
    return both.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
    joined = down.join(least, F.col("u") == F.col("n"))
    return joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()


def components(space: Workspace, edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node on an edge (u, v) of two different nodes.

    Steps are written tables in the shared folder; a step ends when it changes nothing, which is seen from
    the number and the checksum of the edges. Each step takes a few shuffles over the edges alone.
    """
    now = space.save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while True:
        new = space.save(_small_star(_large_star(now)), "stars")
        space.drop(now)
        now, old, mark = new, mark, _mark(new)
        if mark == old:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
