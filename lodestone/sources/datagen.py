"""Seeded generators. A coordinate is a hash of (seed, id, dimension), so it doesn't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kmeans import plus_plus_init
from . import textio

_BITS = 52


def unit(seed: int, *keys: Column) -> Column:
    """Uniform in [0, 1)."""
    return F.xxhash64(F.lit(seed), *keys).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("double") / float(1 << _BITS)


def kmeans_points(spark: SparkSession, n: int = 10_000, d: int = 2, low: float = -1000.0, high: float = 1000.0, seed: int = 0) -> DataFrame:
    """(id, features): uniform in [low, high), rounded to float32 as the text formats hold them."""
    coords = [(unit(seed, F.col("id"), F.lit(j)) * (high - low) + low).cast("float").cast("double") for j in range(d)]
    return spark.range(n).select("id", F.array(*coords).alias("features"))


def knn_points(spark: SparkSession, n: int = 10_000_000, d: int = 2, classes: int = 2, seed: int = 0) -> DataFrame:
    """(id, features, label): uniform in [0, 1) with uniform labels."""
    coords = [unit(seed, F.col("id"), F.lit(j)) for j in range(d)]
    return spark.range(n).select("id", F.array(*coords).alias("features"), F.floor(unit(seed, F.col("id"), F.lit(d)) * classes).cast("int").alias("label"))


def kmeans_file(spark: SparkSession, path: str, n: int = 10_000, d: int = 2, k: int = 4, max_iters: int = 10_000, seed: int = 0) -> None:
    """A runnable F1 input: kmeans_points, with centroids by k-means++."""
    points = kmeans_points(spark, n, d, seed=seed)
    textio.write_f1(spark, path, points, plus_plus_init(points, k, seed), max_iters)


def knn_file(spark: SparkSession, path: str, n: int = 10_000_000, d: int = 2, k: int = 5, classes: int = 2, seed: int = 0) -> None:
    """A runnable F5 input: knn_points, with a uniform target."""
    target = spark.range(1).select(F.array(*[unit(seed, F.lit(-1), F.lit(j)) for j in range(d)]).alias("t")).first()["t"]
    textio.write_f5(spark, path, k, list(target), knn_points(spark, n, d, classes, seed))
