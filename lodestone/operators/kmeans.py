"""Lloyd's k-means with deterministic ties, an exact L1 stop rule and exact pruning.

The k x d centroids live on the driver between iterations (bounded by k, not by the input); a step is one
pass over the points: project distances, take the argmin, aggregate sums partially and finally. Labels are
those against the centroids *before* the last update (label lag): a step labels, then updates. A point without a vector,
or with one of another length, fails the job."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import centroid_distances, matrix_of, nearest, squared
from ..functions.positions import ranked
from ..functions.vectors import require_dimension
from ..session import discard

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package
Matrix = list[list[float]]
#: Iteration stops when the L1 shift of all centroids falls below this fixed value.
MAX_ERR = 1e-6


def init_strided(points: DataFrame, k: int) -> Matrix:
    """Centroid i is the point at position i * (n div k) in id order; points of one id go by a hash of their vectors.
    Only ids and hashes are sorted."""
    n = points.count()
    if not 1 <= k <= n:
        raise ValueError(f"k must be between 1 and the number of points, {n}")
    mark = F.xxhash64("features").alias("mark")
    placed, table = ranked(points.select("id", mark), "at", "id", "mark")
    wanted = placed.filter((F.col("at") % (n // k) == 0) & (F.col("at") < k * (n // k))).collect()  # k rows
    discard(table)
    ids = list({r["id"] for r in wanted})
    rows = points.select("id", mark, "features").filter(F.col("id").isin(ids)).distinct().collect()  # k rows, and others of their ids
    vectors = {(r["id"], r["mark"]): list(r["features"]) for r in rows}
    return [vectors[r["id"], r["mark"]] for r in sorted(wanted, key=lambda r: r["at"])]


def centroid_frame(spark: SparkSession, centroids: Matrix) -> DataFrame:
    """(cluster_id, dim, value)"""
    rows = [(i, j, float(v)) for i, c in enumerate(centroids) for j, v in enumerate(c)]
    return spark.createDataFrame(rows, "cluster_id int, dim int, value double")


def distance_matrix(points: DataFrame, centroids: Matrix) -> DataFrame:
    """(id, cluster_id, distance), n x k rows."""
    roots = F.transform(centroid_distances(F.col("features"), centroids), F.sqrt)
    return require_dimension(points, len(centroids[0])).select("id", F.posexplode(roots).alias("cluster_id", "distance"))


def assign(points: DataFrame, centroids: Matrix) -> DataFrame:
    """points plus cluster_id: the nearest centroid, the lowest id on a tie. A projection; works on streams too."""
    return require_dimension(points, len(centroids[0])).withColumn("_ds", centroid_distances(F.col("features"), centroids)).withColumn("cluster_id", nearest(F.col("_ds"))).drop("_ds")


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def _sums(assigned: DataFrame, d: int) -> dict[int, tuple[int, list[float]]]:
    sums = [F.sum(F.col("features")[j]).alias(f"s{j}") for j in range(d)]
    rows = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), *sums).collect()  # k rows
    return {r["cluster_id"]: (r["n"], [r[f"s{j}"] for j in range(d)]) for r in rows}


def step(points: DataFrame, centroids: Matrix) -> Matrix:
    """One update: the mean of each cluster; an empty cluster keeps its centroid."""
    return _means(_sums(assign(points, centroids), len(centroids[0])), centroids)


def _means(sums: dict[int, tuple[int, list[float]]], old: Matrix) -> Matrix:
    return [[s / sums[i][0] for s in sums[i][1]] if i in sums else list(c) for i, c in enumerate(old)]


def shift(old: Matrix, new: Matrix) -> float:
    """L1 distance of two centroid matrices."""
    return sum(abs(a - b) for x, y in zip(old, new, strict=True) for a, b in zip(x, y, strict=True))


@dataclass
class Fit:
    labelled_with: Matrix  # the centroids that the labels refer to
    centroids: Matrix
    iterations: int
    shift: float

    def labels(self, points: DataFrame) -> DataFrame:
        return assign(points, self.labelled_with).select("id", "cluster_id")


def fit(points: DataFrame, centroids: Sequence[Sequence[float]], max_iters: int, tol: float = MAX_ERR) -> Fit:
    """At most max_iters steps; stops when the shift is below tol. The points are cached for the loop."""
    if max_iters < 1:
        raise ValueError("max_iters must be at least 1")
    current = [list(map(float, c)) for c in centroids]
    cached = points.select("id", "features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for done in range(1, max_iters + 1):
            new = step(cached, current)
            moved = shift(current, new)
            before, current = current, new
            if moved < tol:
                break
    finally:
        cached.unpersist()
    return Fit(before, current, done, moved)


def icd(centroids: Matrix) -> Matrix:
    """Distances between centroids."""
    return [[sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5 for y in centroids] for x in centroids]


def icd_frame(spark: SparkSession, centroids: Matrix) -> DataFrame:
    """(i, j, icd)"""
    rows = [(i, j, v) for i, r in enumerate(icd(centroids)) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "i int, j int, icd double")


def _pruned(x: np.ndarray, old: np.ndarray, centroids: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, compared) of points with old labels. A centroid i with between[old][i] > 2 d, d being the distance to the
    old one, can't be nearer, and its distance isn't evaluated. A tie goes to the old label, then to the lowest id."""
    old_d = np.zeros(len(x))
    for j in range(centroids.shape[1]):
        old_d += (x[:, j] - centroids[old, j]) ** 2
    old_d = np.sqrt(old_d)
    near = between[old] <= 2 * old_d[:, None]
    near[np.arange(len(x)), old] = False
    best, label = old_d.copy(), old.copy()
    for i in range(len(centroids)):
        rows = np.flatnonzero(near[:, i])
        d = np.sqrt(squared(x[rows], centroids[i : i + 1])[:, 0])
        closer = rows[d < best[rows]]
        best[closer], label[closer] = d[d < best[rows]], i
    return label, near.sum(axis=1) + 1


def _compared(features: Column, old_label: Column | None, before: Matrix | None, centroids: Matrix) -> Column:
    """struct<cluster_id, compared>; old labels are given, or those against the centroids before."""
    now, gaps = np.asarray(centroids, dtype=np.float64), np.asarray(icd(centroids))
    then = None if before is None else np.asarray(before, dtype=np.float64)

    def made(x: np.ndarray, old: np.ndarray) -> pa.Array:
        label, compared = _pruned(x, old, now, gaps)
        return pa.StructArray.from_arrays([pa.array(label.astype(np.int32)), pa.array(compared.astype(np.int32))], names=["cluster_id", "compared"])

    kind = "struct<cluster_id:int,compared:int>"
    if old_label is None:

        @F.arrow_udf(kind)
        def from_before(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                x = matrix_of(batch, now.shape[1])
                yield made(x, np.zeros(len(x), np.int64) if then is None else squared(x, then).argmin(axis=1))

        return from_before(features)

    @F.arrow_udf(kind)
    def from_label(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch, old in batches:
            yield made(matrix_of(batch, now.shape[1]), old.to_numpy(zero_copy_only=False).astype(np.int64))

    return from_label(features, old_label)


def assign_pruned(labelled: DataFrame, centroids: Matrix) -> DataFrame:
    """labelled (id, features, old_label) plus cluster_id, compared and skipped."""
    judged = require_dimension(labelled, len(centroids[0])).withColumn("_c", _compared(F.col("features"), F.col("old_label"), None, centroids))
    return judged.select("id", "features", "_c.cluster_id", "_c.compared", (F.lit(len(centroids)) - F.col("_c.compared")).alias("skipped"))


def _relabelled(points: DataFrame, before: Matrix | None, centroids: Matrix) -> DataFrame:
    """points (id, features) plus cluster_id; the old labels are those against the centroids before, or 0, in the same pass."""
    judged = require_dimension(points, len(centroids[0])).withColumn("_c", _compared(F.col("features"), None, before, centroids))
    return judged.select("id", "features", "_c.cluster_id")


def fit_pruned(points: DataFrame, centroids: Sequence[Sequence[float]], max_iters: int, tol: float = MAX_ERR) -> tuple[Fit, DataFrame]:
    """fit() by pruned assignment. Old labels aren't carried from step to step as state: they are those
    against the centroids before, made in the same pass, so the lineage doesn't grow."""
    if max_iters < 1:
        raise ValueError("max_iters must be at least 1")
    current = [list(map(float, c)) for c in centroids]
    cached = points.select("id", "features").persist(StorageLevel.MEMORY_AND_DISK)
    before: Matrix | None = None
    try:
        for done in range(1, max_iters + 1):
            new = _means(_sums(_relabelled(cached, before, current), len(current[0])), current)
            moved = shift(current, new)
            older, before, current = before, current, new
            if moved < tol:
                break
    finally:
        cached.unpersist()
    return Fit(before, current, done, moved), _relabelled(points, older, before)


def with_old(points: DataFrame, before: Matrix | None) -> DataFrame:
    """points plus old_label against the centroids before; 0 before the first step."""
    if before is None:
        return points.select("id", "features", F.lit(0).alias("old_label"))
    return assign(points, before).select("id", "features", F.col("cluster_id").alias("old_label"))


def plus_plus_init(points: DataFrame, k: int, seed: int = 0) -> Matrix:
    """Seeded k-means++: every next centroid is drawn with a weight of the squared distance to the nearest one
    so far, as the least of exponential keys -ln(u) / d2, one pass and one row to the driver for each."""
    keyed = points.select("id", "features", ((F.xxhash64(F.lit(seed), F.col("id")) % 1000003 + 1000003) % 1000003).alias("_u"))
    first = keyed.orderBy("_u", "id").select("features").first()
    if first is None:
        raise ValueError("no points")
    chosen = [list(first[0])]
    while len(chosen) < k:
        u = (F.xxhash64(F.lit(seed + len(chosen)), F.col("id")).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 1) / float(1 << 52)
        d2 = F.array_min(centroid_distances(F.col("features"), chosen))
        row = points.select("id", "features", u.alias("_u"), d2.alias("_d2")).filter("_d2 > 0").orderBy(-F.log("_u") / F.col("_d2"), "id").select("features").first()
        if row is None:  # fewer distinct points than k
            break
        chosen.append(list(row[0]))
    return chosen
