"""Connected components of a distributed edge list by alternating large and small stars.

A round rewires every edge to the least neighbour seen (O(log^2 n) rounds at worst, a handful in practice). Minima
are aggregated partially before the shuffle, so a node with very many edges costs a row per task there, and written; the
joins back are plain sort-merge joins, which adaptive execution splits at hot nodes. Every round is a written table:
nothing goes to the driver but a count and a checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return moved.filter("u <> v").distinct(), least


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum((F.xxhash64("u", "v") % 1_000_000_007).cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, root): the least node of each component, for every node that has an edge and isn't a root."""
    now = written(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        wide, a = _large_star(now)
        wide = written(wide, "edges")
        small, b = _small_star(wide)
        last, now = now, written(small, "edges")
        discard(last, wide, a, b)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
