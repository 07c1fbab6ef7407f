"""The registered queries on the driver's tables and the SQL that an independent engine answers them with.

Canonical settings: target vec_id 0, excluded from the candidates; k = 5 neighbours; 10 clusters; 5 iterations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import kmeans, knn, metrics
from ..session import fresh_path, spread
from ..sources import datagen, textio

TARGET, K, CLUSTERS, ITERS, PART_CLUSTERS = 0, 5, 10, 5, 4
Query = Callable[[SparkSession, str], DataFrame]


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.points(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", F.col("embedding"), "label")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.points(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice")))


def _target(points: DataFrame) -> tuple[DataFrame, list[float]]:
    return points.filter(F.col("id") != TARGET), vectors.vector_of(points, TARGET)


def _vec(df: DataFrame) -> DataFrame:
    df = df.withColumnRenamed("id", "vec_id") if "id" in df.columns else df
    return df.withColumn("distance", F.round("distance", 6)) if "distance" in df.columns else df


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in columns})


def distance_query(squared: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rest, target = _target(embeddings(spark, sf_dir))
        return _vec(knn.distances(rest, target, squared).select("id", "distance"))

    return run


def neighbor_query(tie: str = "id") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _vec(knn.neighbors(*_target(embeddings(spark, sf_dir)), K, tie))

    return run


def vote_query(tie: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return knn.classify(*_target(embeddings(spark, sf_dir)), K, vote_tie=tie)

    return run


def full_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vec(knn.full_ranking(*_target(embeddings(spark, sf_dir))))


def farthest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vec(knn.farthest(*_target(embeddings(spark, sf_dir)), K))


def result_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.result_line(knn.neighbors(*_target(embeddings(spark, sf_dir)), K))


def selfcheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest, target = _target(embeddings(spark, sf_dir))
    return knn.selfcheck(rest, target, knn.neighbors(rest, target, K))


def _start(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, kmeans.Matrix]:
    points = spread(embeddings(spark, sf_dir))
    return points, kmeans.init_strided(points, CLUSTERS)


def init_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(kmeans.centroid_frame(spark, _start(spark, sf_dir)[1]), "value")


def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vec(kmeans.distance_matrix(*_start(spark, sf_dir)))


def assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vec(kmeans.assign(*_start(spark, sf_dir)).select("id", "cluster_id"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster_sizes(kmeans.assign(*_start(spark, sf_dir)))


def step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(kmeans.centroid_frame(spark, kmeans.step(*_start(spark, sf_dir))), "value")


def shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, old = _start(spark, sf_dir)
    return _rounded(spark.createDataFrame([(kmeans.shift(old, kmeans.step(points, old)),)], "shift double"), "shift")


def centroid_icd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(kmeans.icd_frame(spark, _start(spark, sf_dir)[1]), "icd")


def _fit(spark: SparkSession, sf_dir: str, iters: int = ITERS) -> tuple[DataFrame, kmeans.Fit]:
    points, start = _start(spark, sf_dir)
    return points, kmeans.fit(points, start, iters)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, fitted = _fit(spark, sf_dir)
    return _vec(fitted.labels(points))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(kmeans.centroid_frame(spark, _fit(spark, sf_dir)[1].centroids), "value")


def assign_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vec(kmeans.fit_pruned(*_start(spark, sf_dir), ITERS)[1].select("id", "cluster_id"))


def prune_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the second step's comparisons at d = 2: k * n in all, however they split."""
    points = spread(parts(spark, sf_dir))
    start = kmeans.init_strided(points, PART_CLUSTERS)
    pruned = kmeans.assign_pruned(kmeans.with_old(points, start), kmeans.step(points, start))
    return pruned.agg(F.sum("compared").cast("bigint").alias("compared"), F.sum("skipped").cast("bigint").alias("skipped"))


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, start = _start(spark, sf_dir)
    last = kmeans.fit(points, start, ITERS).labels(points)
    first = kmeans.assign(points, start).select("id", "cluster_id")
    return _rounded(metrics.label_agreement(first, last), "ratio")


def points_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.array_join(F.transform("values", lambda x: vectors.fixed(x, 6)), " ")
    return vectors.transpose(embeddings(spark, sf_dir)).select("dim", joined.alias("values"))


def part_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = parts(spark, sf_dir)
    first = points.agg(F.min("id")).first()[0]
    near = knn.neighbors(points.filter(F.col("id") != first), vectors.vector_of(points, first), K)
    return _rounded(near.withColumnRenamed("id", "p_partkey"), "distance")


def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spread(parts(spark, sf_dir))
    fitted = kmeans.fit(points, kmeans.init_strided(points, PART_CLUSTERS), ITERS)
    return fitted.labels(points).withColumnRenamed("id", "p_partkey")


def batch_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all others."""
    points = embeddings(spark, sf_dir)
    found = knn.neighbors_of_many(points, points.filter(F.col("id") % 100 == 0), K, exclude_self=True)
    return _vec(found)


# --- files: each query writes one, reads it back and shows what it read -----------------------------------


def _part_file(spark: SparkSession, sf_dir: str, layout: str) -> textio.KMeansInput:
    points, path = parts(spark, sf_dir), fresh_path(spark, f"text-{layout}")
    start = kmeans.init_strided(points, PART_CLUSTERS)
    if layout == "F3":
        textio.write_f3(spark, path, points, PART_CLUSTERS, ITERS)
    else:
        {"F1": textio.write_f1, "F2": textio.write_f2}[layout](spark, path, points, start, ITERS)
    return textio.read_kmeans(spark, path, layout)


def file_points(layout: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = _part_file(spark, sf_dir, layout).points
        return read.select("id", F.round(F.col("features")[0], 6).alias("x"), F.round(F.col("features")[1], 6).alias("y"))

    return run


def file_centroids(layout: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = _part_file(spark, sf_dir, layout)
        cells = _rounded(kmeans.centroid_frame(spark, read.centroids), "value")
        return cells.withColumns({"n": F.lit(read.n), "d": F.lit(read.d), "k": F.lit(read.k), "max_iters": F.lit(read.max_iters)})

    return run


def _knn_file(spark: SparkSession, sf_dir: str, words: bool) -> textio.KnnInput:
    rest, target = _target(embeddings(spark, sf_dir))
    path = fresh_path(spark, "text-F5")
    labelled = rest.withColumn("label", F.concat(F.lit("class-"), F.col("label").cast("string"))) if words else rest
    textio.write_f5(spark, path, K, target, labelled)
    return textio.read_knn(spark, path, "string" if words else "int")


def knn_file_rows(words: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = _knn_file(spark, sf_dir, words)
        d = F.round(F.sqrt(knn.sq_dist(F.col("features"), read.target)), 6)
        return read.points.select("id", "label", d.alias("distance"), F.lit(read.k).alias("k"), F.lit(read.n).alias("n"), F.lit(read.d).alias("d"))

    return run


def _fit_file(spark: SparkSession, sf_dir: str) -> str:
    points, path = parts(spark, sf_dir), fresh_path(spark, "text-F4")
    start = kmeans.init_strided(points, PART_CLUSTERS)
    textio.write_f4(spark, path, start, kmeans.assign(points, start).select("id", "cluster_id"))
    return path


def fit_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textio.lines(spark, _fit_file(spark, sf_dir)).withColumnRenamed("value", "line")


def fit_file_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(kmeans.centroid_frame(spark, textio.read_centroids(spark, _fit_file(spark, sf_dir), PART_CLUSTERS)), "value")


def fit_file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textio.read_labels(spark, _fit_file(spark, sf_dir), PART_CLUSTERS)


def neighbor_file_lines(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rest, target = _target(embeddings(spark, sf_dir))
        near, path = knn.neighbors(rest, target, K), fresh_path(spark, f"text-{kind}")
        if kind == "F6":
            textio.write_f6(path, near, rest, knn.vote(near))
        elif kind == "F7":
            textio.write_f7(path, knn.result_line(near))
        else:
            textio.write_coordinates(path, near, rest)
        return textio.lines(spark, path).withColumnRenamed("value", "line")

    return run


def missing_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(error): the condition under which a file that isn't there fails."""
    from pyspark.errors import AnalysisException

    try:
        textio.read_knn(spark, fresh_path(spark, "missing"))
    except AnalysisException as error:
        return spark.createDataFrame([(error.getCondition(),)], "error string")
    raise AssertionError("a missing file was read")


def generated_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: sizes of a generated F1 file, whether all its numbers are in range, how many distinct points are centroids."""
    path = fresh_path(spark, "text-generated")
    datagen.kmeans_file(spark, path, 1000, 3, 4, 50, seed=7)
    read = textio.read_kmeans(spark, path, "F1")
    inside = F.forall("features", lambda x: (x >= -1000) & (x < 1000) & (x.cast("float").cast("double") == x))
    central = F.count_distinct(F.when(F.col("features").isin([F.array(*map(F.lit, c)) for c in read.centroids]), F.col("features")))
    facts = read.points.agg(F.count(F.lit(1)).alias("n"), F.bool_and(inside & (F.size("features") == read.d)).alias("in_range"), central.alias("central_points"))
    return facts.withColumns({"k": F.lit(read.k), "d": F.lit(read.d), "max_iters": F.lit(read.max_iters)})


def generated_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: sizes of a generated F5 file, whether all its numbers are in range, and its labels."""
    path = fresh_path(spark, "text-generated")
    datagen.knn_file(spark, path, 1000, 2, 5, 3, seed=7)
    read = textio.read_knn(spark, path)
    inside = F.forall("features", lambda x: (x >= 0) & (x < 1))
    facts = read.points.agg(F.count(F.lit(1)).alias("n"), F.bool_and(inside).alias("in_range"), F.array_join(F.array_sort(F.collect_set("label")), " ").alias("labels"))
    return facts.withColumns({"k": F.lit(read.k), "d": F.lit(len(read.target)), "target_in_range": F.lit(all(0 <= x < 1 for x in read.target))})


def queries() -> dict[str, Query]:
    return {
        "dist_sq_to_target": distance_query(True), "dist_to_target": distance_query(False),
        "knn_neighbors": neighbor_query(), "knn_neighbors_label_tie": neighbor_query("label"),
        "knn_full_ranking": full_ranking, "knn_farthest": farthest,
        "knn_vote": vote_query("smallest"), "knn_vote_nearest_tie": vote_query("nearest"),
        "knn_result_line": result_line, "knn_selfcheck": selfcheck,
        "kmeans_init_strided": init_strided, "kmeans_distance_matrix": distance_matrix, "kmeans_assign": assign,
        "cluster_sizes": sizes, "kmeans_step": step, "kmeans_shift": shift, "centroid_icd": centroid_icd,
        "kmeans_labels": labels, "kmeans_centroids": centroids,
        "kmeans_assign_pruned": assign_pruned, "kmeans_prune_stats": prune_stats,
        "label_agreement": agreement, "points_transpose": points_transpose,
        "part_knn_neighbors": part_neighbors, "part_kmeans_labels": part_labels, "knn_batch": batch_neighbors,
        "read_f1_points": file_points("F1"), "read_f2_points": file_points("F2"), "read_f3_points": file_points("F3"),
        "read_f1_centroids": file_centroids("F1"), "read_f2_centroids": file_centroids("F2"), "read_f3_centroids": file_centroids("F3"),
        "read_f5_points": knn_file_rows(False), "read_f5_class_words": knn_file_rows(True),
        "write_f4_lines": fit_file_lines, "read_f4_centroids": fit_file_centroids, "read_f4_labels": fit_file_labels,
        "write_f6_lines": neighbor_file_lines("F6"), "write_f7_lines": neighbor_file_lines("F7"), "write_coordinates_lines": neighbor_file_lines("co"),
        "read_missing_file": missing_file, "generated_kmeans_file": generated_kmeans, "generated_knn_file": generated_knn,
    }


# --- SQL -------------------------------------------------------------------------------------------------

_PTS = "p AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_PART = "p AS MATERIALIZED (SELECT p_partkey AS id, [p_size::DOUBLE, p_retailprice] AS v FROM part)"
_SQ = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _near() -> str:
    sq = _SQ.format(a="p.v", b="t.v")
    return f"{_PTS}, q AS MATERIALIZED (SELECT p.id, p.label, {sq} AS d FROM p, (SELECT v FROM p WHERE id = {TARGET}) t WHERE p.id <> {TARGET})"


def _top(order: str = "d, id") -> str:
    return f"{_near()}, r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {order}) AS rank, id, label, d FROM q QUALIFY rank <= {K})"


def _lloyd(points: str, k: int, iters: int) -> str:
    """c0, l1, c1, .. l<iters>, c<iters>: labels l<t> are against c<t-1>."""
    pick = f"SELECT (rn // step)::INT AS j, v FROM (SELECT v, row_number() OVER (ORDER BY id) - 1 AS rn, count(*) OVER () // {k} AS step FROM p) WHERE rn % step = 0 AND rn // step < {k}"
    ctes = [points, f"c0 AS MATERIALIZED ({pick})"]
    for t in range(1, iters + 1):
        sq = _SQ.format(a="p.v", b="c.v")
        ctes.append(f"l{t} AS MATERIALIZED (SELECT p.id, arg_min(c.j, ({sq}, c.j)) AS j FROM p, c{t - 1} c GROUP BY p.id)")
        ctes.append(f"m{t} AS MATERIALIZED (SELECT j, i, avg(x) AS x FROM (SELECT l.j, generate_subscripts(p.v, 1) AS i, unnest(p.v) AS x FROM p JOIN l{t} l USING (id)) GROUP BY j, i)")
        ctes.append(f"c{t} AS MATERIALIZED (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{t - 1} c LEFT JOIN (SELECT j, list(x ORDER BY i) AS v FROM m{t} GROUP BY j) m ON c.j = m.j)")
    return ", ".join(ctes)


def _cells(name: str) -> str:
    return f"SELECT j AS cluster_id, (generate_subscripts(v, 1) - 1)::INT AS dim, round(unnest(v), 6) AS value FROM {name}"


def oracle_sql() -> dict[str, str]:
    sq, one = _SQ.format(a="p.v", b="c.v"), _lloyd(_PTS, CLUSTERS, 1)
    five = _lloyd(_PTS, CLUSTERS, ITERS)
    between = _SQ.format(a="a.v", b="b.v")
    pruned = (
        f"WITH {_lloyd(_PART, PART_CLUSTERS, 1)}, o AS (SELECT p.id, p.v, l.j, sqrt({_SQ.format(a='p.v', b='c.v')}) AS d FROM p JOIN l1 l USING (id) JOIN c1 c ON c.j = l.j), "
        f"n AS (SELECT o.id, count(*) FILTER (WHERE b.j = o.j OR sqrt({between}) <= 2 * o.d) AS compared, count(*) AS every FROM o JOIN c1 a ON a.j = o.j, c1 b GROUP BY o.id) "
        "SELECT sum(compared)::BIGINT AS compared, sum(every - compared)::BIGINT AS skipped FROM n"
    )
    first = "(SELECT min(p_partkey) FROM part)"
    part_one = _lloyd(_PART, PART_CLUSTERS, 1)
    points = "WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, p_size::DOUBLE AS x, p_retailprice AS y FROM part) SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM p"
    heads = f"WITH {part_one} SELECT *, (SELECT count(*)::INT FROM p) AS n, 2 AS d, {PART_CLUSTERS} AS k, {ITERS} AS max_iters FROM ({_cells('c0')})"
    coords = "array_to_string(list_transform(v, lambda x: printf('%.10f ', x)), '')"
    near = f"WITH {_top()}, m AS (SELECT r.rank, r.label, {coords} AS c FROM r JOIN p USING (id))"
    f5 = f"WITH {_near()} SELECT row_number() OVER (ORDER BY id) - 1 AS id, {{label}} AS label, round(sqrt(d), 6) AS distance, {K} AS k, (SELECT count(*)::INT FROM q) AS n, (SELECT len(v)::INT FROM p LIMIT 1) AS d FROM q"
    files = {"F1": "read_f1", "F2": "read_f2", "F3": "read_f3"}
    return {f"{name}_points": points for name in files.values()} | {f"{name}_centroids": heads for name in files.values()} | {
        "knn_batch": f"WITH {_PTS} SELECT a.id AS query_id, (row_number() OVER (PARTITION BY a.id ORDER BY {between}, b.id))::INT AS rank, b.id AS vec_id, round(sqrt({between}), 6) AS distance FROM p a, p b WHERE a.id % 100 = 0 AND a.id <> b.id QUALIFY rank <= {K}",
        "read_f5_points": f5.format(label="label"), "read_f5_class_words": f5.format(label="'class-' || label"),
        "write_f4_lines": f"WITH {part_one} SELECT j::BIGINT AS line_no, array_to_string(list_transform(v, lambda x: printf('%.6f ', x)), '') AS line FROM c0 UNION ALL SELECT row_number() OVER (ORDER BY id) - 1 + {PART_CLUSTERS}, j::VARCHAR FROM l1",
        "read_f4_centroids": f"WITH {part_one} {_cells('c0')}",
        "read_f4_labels": f"WITH {part_one} SELECT row_number() OVER (ORDER BY id) - 1 AS id, j AS cluster_id FROM l1",
        "write_f6_lines": f"{near} SELECT rank - 1 AS line_no, c || 'label: ' || label AS line FROM m UNION ALL SELECT count(*), 'classifed class:' || (SELECT label FROM r GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) FROM m",
        "write_f7_lines": f"WITH {_top()} SELECT 0::BIGINT AS line_no, (SELECT label FROM r GROUP BY label ORDER BY count(*) DESC, min(rank) LIMIT 1)::VARCHAR AS line UNION ALL SELECT 1, string_agg(id::VARCHAR, ' ' ORDER BY rank) FROM r",
        "write_coordinates_lines": f"{near} SELECT rank - 1 AS line_no, c AS line FROM m",
        "read_missing_file": "SELECT 'PATH_NOT_FOUND' AS error",
        "generated_kmeans_file": "SELECT 1000::BIGINT AS n, true AS in_range, 4::BIGINT AS central_points, 4 AS k, 3 AS d, 50 AS max_iters",
        "generated_knn_file": "SELECT 1000::BIGINT AS n, true AS in_range, '0 1 2' AS labels, 5 AS k, 2 AS d, true AS target_in_range",
        "dist_sq_to_target": f"WITH {_near()} SELECT id AS vec_id, round(d, 6) AS distance FROM q",
        "dist_to_target": f"WITH {_near()} SELECT id AS vec_id, round(sqrt(d), 6) AS distance FROM q",
        "knn_neighbors": f"WITH {_top()} SELECT rank::INT AS rank, id AS vec_id, label, round(sqrt(d), 6) AS distance FROM r",
        "knn_neighbors_label_tie": f"WITH {_top('d, label, id')} SELECT rank::INT AS rank, id AS vec_id, label, round(sqrt(d), 6) AS distance FROM r",
        "knn_full_ranking": f"WITH {_near()} SELECT row_number() OVER (ORDER BY d, id) AS rank, id AS vec_id, round(sqrt(d), 6) AS distance FROM q",
        "knn_farthest": f"WITH {_near()} SELECT (row_number() OVER (ORDER BY d DESC, id DESC))::INT AS rank, id AS vec_id, round(sqrt(d), 6) AS distance FROM q QUALIFY rank <= {K}",
        "knn_vote": f"WITH {_top()} SELECT label AS predicted_label, count(*) AS votes FROM r GROUP BY label ORDER BY votes DESC, label LIMIT 1",
        "knn_vote_nearest_tie": f"WITH {_top()} SELECT label AS predicted_label, count(*) AS votes FROM r GROUP BY label ORDER BY votes DESC, min(rank) LIMIT 1",
        "knn_result_line": f"WITH {_top()} SELECT (SELECT label FROM r GROUP BY label ORDER BY count(*) DESC, min(rank) LIMIT 1) AS predicted_label, (SELECT string_agg(id::VARCHAR, ' ' ORDER BY rank) FROM r) AS neighbor_ids",
        "knn_selfcheck": f"WITH {_top()} SELECT count(*) FILTER (WHERE r.d <> q.d) AS mismatches FROM r JOIN q USING (id)",
        "kmeans_init_strided": f"WITH {one} {_cells('c0')}",
        "kmeans_distance_matrix": f"WITH {one} SELECT p.id AS vec_id, c.j AS cluster_id, round(sqrt({sq}), 6) AS distance FROM p, c0 c",
        "kmeans_assign": f"WITH {one} SELECT id AS vec_id, j AS cluster_id FROM l1",
        "cluster_sizes": f"WITH {one} SELECT j AS cluster_id, count(*) AS n FROM l1 GROUP BY j",
        "kmeans_step": f"WITH {one} {_cells('c1')}",
        "kmeans_shift": f"WITH {one} SELECT round(sum(list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))), 6) AS shift FROM c0 a JOIN c1 b USING (j)",
        "centroid_icd": f"WITH {one} SELECT a.j AS i, b.j AS j, round(sqrt({between}), 6) AS icd FROM c0 a, c0 b",
        "kmeans_labels": f"WITH {five} SELECT id AS vec_id, j AS cluster_id FROM l{ITERS}",
        "kmeans_centroids": f"WITH {five} {_cells(f'c{ITERS}')}",
        "kmeans_assign_pruned": f"WITH {five} SELECT id AS vec_id, j AS cluster_id FROM l{ITERS}",
        "kmeans_prune_stats": pruned,
        "label_agreement": f"WITH {five} SELECT round(avg((a.j = b.j)::INT::DOUBLE), 6) AS ratio FROM l1 a JOIN l{ITERS} b USING (id)",
        "points_transpose": f"WITH {_PTS} SELECT (i - 1)::INT AS dim, string_agg(printf('%.6f', x), ' ' ORDER BY id) AS \"values\" FROM (SELECT id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM p) GROUP BY i",
        "part_knn_neighbors": f"WITH {_PART} SELECT (row_number() OVER (ORDER BY {_SQ.format(a='p.v', b='t.v')}, p.id))::INT AS rank, p.id AS p_partkey, round(sqrt({_SQ.format(a='p.v', b='t.v')}), 6) AS distance FROM p, (SELECT v FROM p WHERE id = {first}) t WHERE p.id <> {first} QUALIFY rank <= {K}",
        "part_kmeans_labels": f"WITH {_lloyd(_PART, PART_CLUSTERS, ITERS)} SELECT id AS p_partkey, j AS cluster_id FROM l{ITERS}",
    }
