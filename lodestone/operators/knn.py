"""Exact nearest neighbours of one target vector and majority-vote classification.

Ranking uses the squared distance; the root is taken only for output. ``orderBy(...).limit(k)`` plans as
TakeOrderedAndProject: every partition keeps its k best and the driver merges k rows a partition, so nothing
of the size of the input is shuffled. A point without a vector, or with one of another length than the target's, fails
the job: its distance would be null and rank first."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import matrix_of, sq_dist, squared
from ..functions.positions import ranked
from ..functions.vectors import require_dimension

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package
#: Sort keys after the distance. Ties at the k-th place are decided by them.
TIES = {"id": ["id"], "label": ["label", "id"]}
#: Queries whose vectors are broadcast at once; more are answered in blocks.
BLOCK = 1024


def _scored(points: DataFrame, target: Sequence[float]) -> DataFrame:
    """points with _d, the squared distance."""
    return require_dimension(points, len(target)).withColumn("_d", sq_dist(F.col("features"), target))


def distances(points: DataFrame, target: Sequence[float], squared: bool = False) -> DataFrame:
    """points plus ``distance``; a projection, no shuffle."""
    return _scored(points, target).withColumn("distance", F.col("_d") if squared else F.sqrt("_d")).drop("_d")


def neighbors(points: DataFrame, target: Sequence[float], k: int, tie: str = "id") -> DataFrame:
    """The k nearest points as (rank, id, [label], distance), all of them if there are fewer than k."""
    kept = [c for c in ("id", "label") if c in points.columns]
    near = _scored(points, target).select(*kept, "_d").orderBy("_d", *TIES[tie]).limit(k)
    ranked = near.withColumn("rank", F.row_number().over(Window.orderBy("_d", *TIES[tie])))
    return ranked.select("rank", *kept, F.sqrt("_d").alias("distance"))


def farthest(points: DataFrame, target: Sequence[float], k: int) -> DataFrame:
    """The last k of the full ranking, farthest first: (rank, id, distance), rank 1 is the farthest."""
    far = _scored(points, target).select("id", "_d").orderBy(F.desc("_d"), F.desc("id")).limit(k)
    return far.select(F.row_number().over(Window.orderBy(F.desc("_d"), F.desc("id"))).alias("rank"), "id", F.sqrt("_d").alias("distance"))


def full_ranking(points: DataFrame, target: Sequence[float]) -> DataFrame:
    """Every point with its rank, as (rank, id, distance): sorted once by distance and id into range partitions, which a
    written table keeps; a rank is the place in a partition plus the rows of all before it. No task sees all rows, and
    points of equal distance are many partitions' work."""
    placed, _ = ranked(_scored(points, target).select("_d", "id"), "_at", "_d", "id")
    return placed.select((F.col("_at") + 1).alias("rank"), "id", F.sqrt("_d").alias("distance"))


def neighbors_of_many(points: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest points of every query (id, features), ties by id.

    The queries are a stated set: blocks of BLOCK vectors go to all tasks, which keep k points a query of what they
    read, so k rows a query and task are shuffled. exclude_self leaves out the point of the query's own id."""
    found = None
    rows = queries.select("id", "features").toLocalIterator()
    while block := list(islice(rows, BLOCK)):
        part = _best_of_block(points, [r["id"] for r in block], [r["features"] for r in block], k, exclude_self)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return points.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, distance double")
    own = Window.partitionBy("query_id").orderBy("d", "id")
    best = found.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "id", F.sqrt("d").alias("distance"))


def _best_of_block(points: DataFrame, ids: list[int], vectors: list[Sequence[float]], k: int, exclude_self: bool) -> DataFrame:
    """(query_id, id, d): for each query the k nearest points of each partition."""
    shared = points.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), np.array(vectors, np.float64)))
    d = len(vectors[0])

    def cut(found: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k least by (distance, id)."""
        if len(found) > k:
            kept = found <= np.partition(found, k - 1)[k - 1]
            found, own = found[kept], own[kept]
        order = np.lexsort((own, found))[:k]
        return found[order], own[order]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, targets = shared.value
        best = [(np.empty(0), np.empty(0, np.int64)) for _ in asked]
        for batch in stream:
            own, distances = batch.column("id").to_numpy(), squared(matrix_of(batch.column("features"), d), targets)
            for q, query in enumerate(asked):
                column = distances[:, q]
                if len(best[q][0]) == k:  # most batches hold nothing nearer
                    near = column <= best[q][0][-1]
                else:
                    near = np.ones(len(own), bool)
                if exclude_self:
                    near &= own != query
                if near.any():
                    best[q] = cut(np.concatenate([best[q][0], column[near]]), np.concatenate([best[q][1], own[near]]))
        sizes = [len(x) for x, _ in best]
        columns = [np.repeat(asked, sizes), np.concatenate([i for _, i in best]), np.concatenate([x for x, _ in best])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "d"])

    checked = require_dimension(points.select("id", "features"), d)
    return checked.mapInArrow(batches, "query_id bigint, id bigint, d double")


def vote(neighbours: DataFrame, tie: str = "smallest") -> DataFrame:
    """(predicted_label, votes), one row; label -1 with 0 votes if there are no neighbours.

    tie: "smallest" gives a tied vote to the smallest label, "nearest" to the label of the nearest neighbour."""
    counts = neighbours.groupBy("label").agg(F.count(F.lit(1)).alias("votes"), F.min("rank").alias("_first"))
    order = [F.col("label")] if tie == "smallest" else [F.col("_first")]
    won = counts.orderBy(F.desc("votes"), *order).limit(1)
    best = F.max(F.struct("votes", "label"))
    return won.agg(best.alias("_b")).select(
        F.coalesce(F.col("_b.label"), F.lit(-1)).cast("int").alias("predicted_label"),
        F.coalesce(F.col("_b.votes"), F.lit(0)).cast("bigint").alias("votes"),
    )


def classify(points: DataFrame, target: Sequence[float], k: int, tie: str = "id", vote_tie: str = "smallest") -> DataFrame:
    return vote(neighbors(points, target, k, tie), vote_tie)


def result_line(neighbours: DataFrame, vote_tie: str = "nearest") -> DataFrame:
    """(predicted_label, neighbor_ids): the winner and the ids, nearest first, joined by single spaces."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string"))
    line = neighbours.agg(F.array_join(ids, " ").alias("neighbor_ids"))
    return vote(neighbours, vote_tie).select("predicted_label").crossJoin(line)  # one row by one row


def selfcheck(points: DataFrame, target: Sequence[float], found: DataFrame) -> DataFrame:
    """(mismatches): found rows whose distance differs from the one computed anew from their id."""
    again = _scored(points, target).select("id", F.sqrt("_d").alias("_again"))
    joined = again.join(F.broadcast(found.select("id", "distance")), "id", "inner")  # found has k rows
    return joined.agg(F.coalesce(F.sum(F.when(F.col("distance") != F.col("_again"), 1).otherwise(0)), F.lit(0)).cast("bigint").alias("mismatches"))
