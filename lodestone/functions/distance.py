"""Distance expressions over array columns. All arithmetic is in double, summed from the first dimension to the last."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

#: Up to this many dimensions a distance is written out term by term, which stays inside whole-stage
#: code generation; beyond it, a higher-order function keeps the generated method small.
UNROLL_LIMIT = 64
#: Up to this many terms (centroids x dimensions) all centroid distances are written out in one projection. Ten
#: centroids of 64 dimensions were measured to exceed the JVM's 64 KB method size and fall back to interpretation.
UNROLL_TERMS = 128


def as_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def sq_dist(left: Column, right: Sequence[float]) -> Column:
    """Squared Euclidean distance of an array column to a constant vector."""
    if len(right) <= UNROLL_LIMIT:
        total = None
        for i, value in enumerate(right):
            diff = left[i].cast("double") - F.lit(float(value))
            term = diff * diff
            total = term if total is None else total + term
        return F.lit(0.0) if total is None else total
    return sq_dist_columns(left, as_vector(right))


def sq_dist_columns(left: Column, right: Column) -> Column:
    """Squared Euclidean distance of two array columns of equal length."""
    terms = F.zip_with(left, right, lambda a, b: (a - b) * (a - b))
    return F.aggregate(terms, F.lit(0.0), lambda acc, term: acc + term)


def dist(left: Column, right: Sequence[float]) -> Column:
    return F.sqrt(sq_dist(left, right))


def matrix_of(vectors: pa.Array, d: int) -> np.ndarray:
    """The rows of an Arrow array of lists of d doubles."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(n, k) squared distances, in the same order of summation as the expressions."""
    total = np.zeros((len(x), len(centroids)))
    for j in range(centroids.shape[1]):
        total += (x[:, j, None] - centroids[None, :, j]) ** 2
    return total


def centroid_distances(features: Column, centroids: Sequence[Sequence[float]]) -> Column:
    """array<double> of squared distances to every centroid: generated code for few terms, otherwise one
    Arrow batch at a time in NumPy."""
    if len(centroids) * len(centroids[0]) <= UNROLL_TERMS:
        return F.array(*[sq_dist(features, c) for c in centroids])
    matrix = np.asarray(centroids, dtype=np.float64)

    @F.arrow_udf("array<double>")
    def distances(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = squared(matrix_of(batch, matrix.shape[1]), matrix)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(matrix)), pa.array(found.ravel()))

    return distances(features)


def nearest(distances: Column) -> Column:
    """Index of the least element of an array; the lowest index wins a tie."""
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")
