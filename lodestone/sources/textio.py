"""Readers and writers of the whitespace-separated text formats.

| format | layout |
|---|---|
| F1 | ``n d k maxIters``; k lines of d floats (centroids); d lines of n floats (line j: coordinate j) |
| F2 | the same header and centroids; n lines of d floats |
| F3 | the header; n lines of d floats; centroid i is point i * (n div k) |
| F4 | k centroid lines, then n labels, one a line |
| F5 | ``k``; ``n dim``; the target; n lines ``x1 .. xd label``; labels are integers or words |
| F6 | k lines ``x1 .. xd label: L`` with 10 decimals, then ``classifed class:W`` |
| F7 | the winning label; then the neighbours' ids, nearest first |

Line numbers are places in a partition plus the lines of all partitions before, in generated code; no global window
and no collection. Only headers, centroids and targets (bounded by k and d) go to the driver. F1 lines hold n
numbers each, so F1 suits bounded point sets; F2 and F5 have no such limit. A missing file raises Spark's
PATH_NOT_FOUND."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.positions import numbered
from ..functions.vectors import fixed
from ..operators.kmeans import Matrix, init_strided


@dataclass
class KMeansInput:
    n: int
    d: int
    k: int
    max_iters: int
    centroids: Matrix
    points: DataFrame


@dataclass
class KnnInput:
    k: int
    n: int
    d: int
    target: list[float]
    points: DataFrame


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) without blank lines, line_no from 0."""
    return numbered(spark.read.text(path).filter(F.trim("value") != ""), "line_no").select("line_no", "value")


def _tokens(column: str = "value"):
    return F.split(F.trim(column), r"\s+")


def _floats(tokens):
    return F.transform(tokens, lambda t: t.cast("double"))


def _head(text: DataFrame, until: int, since: int = 0) -> list[list[str]]:
    rows = text.filter((F.col("line_no") >= since) & (F.col("line_no") < until)).select("line_no", _tokens().alias("t")).collect()
    return [list(r["t"]) for r in sorted(rows, key=lambda r: r["line_no"])]


def _row_major(text: DataFrame, first: int, n: int) -> DataFrame:
    body = text.filter((F.col("line_no") >= first) & (F.col("line_no") < first + n))
    return body.select((F.col("line_no") - first).alias("id"), _floats(_tokens()).alias("features"))


def read_kmeans(spark: SparkSession, path: str, layout: str = "F2") -> KMeansInput:
    """An F1, F2 or F3 file."""
    text = lines(spark, path)
    n, d, k, max_iters = (int(float(x)) for x in _head(text, 1)[0][:4])
    if layout == "F3":
        points = _row_major(text, 1, n)
        return KMeansInput(n, d, k, max_iters, init_strided(points, k), points)
    centroids = [[float(x) for x in row] for row in _head(text, 1 + k, 1)]
    if layout == "F2":
        return KMeansInput(n, d, k, max_iters, centroids, _row_major(text, 1 + k, n))
    if layout != "F1":
        raise ValueError(f"unknown layout {layout}")
    body = text.filter((F.col("line_no") > k) & (F.col("line_no") <= k + d))
    cells = body.select((F.col("line_no") - (1 + k)).alias("dim"), F.posexplode(_floats(_tokens())).alias("id", "x"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "x")))
    points = cells.groupBy(F.col("id").cast("bigint").alias("id")).agg(F.transform(ordered, lambda c: c["x"]).alias("features"))
    return KMeansInput(n, d, k, max_iters, centroids, points)


def read_knn(spark: SparkSession, path: str, label: str = "int") -> KnnInput:
    """An F5 file. label: "int" for numbered classes, "string" for words, taken as they are."""
    text = lines(spark, path)
    (k,), (n, d), target = _head(text, 3)
    tokens = _tokens()
    own = F.element_at(tokens, -1)
    body = text.filter((F.col("line_no") >= 3) & (F.col("line_no") < 3 + int(n)))
    points = body.select(
        (F.col("line_no") - 3).alias("id"), _floats(F.slice(tokens, 1, int(d))).alias("features"), (own.cast("double").cast("int") if label == "int" else own).alias("label")
    )
    return KnnInput(int(k), int(n), int(d), [float(x) for x in target], points)


def read_centroids(spark: SparkSession, path: str, k: int) -> Matrix:
    """The first k lines of an F4 file."""
    return [[float(x) for x in row] for row in _head(lines(spark, path), k)]


def read_labels(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """(id, cluster_id): an F4 file without its first ``skip`` lines."""
    body = lines(spark, path).filter(F.col("line_no") >= skip)
    return body.select((F.col("line_no") - skip).alias("id"), F.trim("value").cast("int").alias("cluster_id"))


def _write(rows: DataFrame, path: str) -> None:
    """rows: (order columns.., line). Range-sorted part files; read in name order they are one file."""
    keys = [c for c in rows.columns if c != "line"]
    rows.orderBy(*keys).select("line").write.mode("overwrite").text(path)


def _numbers(vector):
    """With 10 decimals, a space after each."""
    return F.array_join(F.transform(vector, lambda x: F.concat(fixed(x, 10), F.lit(" "))), "")


def write_f2(spark: SparkSession, path: str, points: DataFrame, centroids: Matrix, max_iters: int) -> None:
    n, d, k = points.count(), len(centroids[0]), len(centroids)
    head = [(-1 - k, f"{n} {d} {k} {max_iters}"), *((i - k, " ".join(map(repr, map(float, c)))) for i, c in enumerate(centroids))]
    body = points.select("id", F.array_join(F.transform("features", lambda x: x.cast("string")), " ").alias("line"))
    _write(spark.createDataFrame(head, "id bigint, line string").unionByName(body), path)


def write_f1(spark: SparkSession, path: str, points: DataFrame, centroids: Matrix, max_iters: int) -> None:
    from ..functions.vectors import transpose

    n, d, k = points.count(), len(centroids[0]), len(centroids)
    head = [(-1 - k, f"{n} {d} {k} {max_iters}"), *((i - k, " ".join(map(repr, map(float, c)))) for i, c in enumerate(centroids))]
    body = transpose(points).select(F.col("dim").cast("bigint").alias("id"), F.array_join(F.transform("values", lambda x: x.cast("string")), " ").alias("line"))
    _write(spark.createDataFrame(head, "id bigint, line string").unionByName(body), path)


def write_f3(spark: SparkSession, path: str, points: DataFrame, k: int, max_iters: int) -> None:
    body = points.select("id", F.array_join(F.transform("features", lambda x: x.cast("string")), " ").alias("line"))
    d = points.select(F.size("features").alias("d")).first()["d"]
    _write(spark.createDataFrame([(-1, f"{points.count()} {d} {k} {max_iters}")], "id bigint, line string").unionByName(body), path)


def write_f4(spark: SparkSession, path: str, centroids: Matrix, labels: DataFrame) -> None:
    head = [(i - len(centroids), "".join(f"{v:f} " for v in c)) for i, c in enumerate(centroids)]
    body = labels.select(F.col("id"), F.col("cluster_id").cast("string").alias("line"))
    _write(spark.createDataFrame(head, "id bigint, line string").unionByName(body), path)


def write_f5(spark: SparkSession, path: str, k: int, target: list[float], points: DataFrame) -> None:
    head = [(-3, str(k)), (-2, f"{points.count()} {len(target)}"), (-1, " ".join(map(repr, target)))]
    coords = F.array_join(F.transform("features", lambda x: x.cast("string")), " ")
    body = points.select("id", F.concat_ws(" ", coords, F.col("label").cast("string")).alias("line"))
    _write(spark.createDataFrame(head, "id bigint, line string").unionByName(body), path)


def write_f6(path: str, neighbours: DataFrame, points: DataFrame, winner: DataFrame) -> None:
    """neighbours (rank, id, label, distance), points (id, features), winner (predicted_label)."""
    rows = points.select("id", "features").join(F.broadcast(neighbours), "id")  # k rows
    body = rows.select(F.col("rank").cast("int").alias("rank"), F.concat(_numbers(F.col("features")), F.lit("label: "), F.col("label").cast("string")).alias("line"))
    last = winner.select(F.lit(2**31 - 1).alias("rank"), F.concat(F.lit("classifed class:"), F.col("predicted_label").cast("string")).alias("line"))
    _write(body.unionByName(last), path)


def write_coordinates(path: str, neighbours: DataFrame, points: DataFrame) -> None:
    """The neighbours' coordinates alone, nearest first."""
    rows = points.select("id", "features").join(F.broadcast(neighbours.select("id", "rank")), "id")  # k rows
    _write(rows.select("rank", _numbers(F.col("features")).alias("line")), path)


def write_f7(path: str, line: DataFrame) -> None:
    """line: (predicted_label, neighbor_ids) as of result_line()."""
    both = F.array(F.struct(F.lit(0).alias("at"), F.col("predicted_label").cast("string").alias("line")), F.struct(F.lit(1).alias("at"), F.col("neighbor_ids").alias("line")))
    _write(line.select(F.inline(both)), path)
