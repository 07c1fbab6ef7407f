import pytest

from lodestone.operators import kmeans, knn
from lodestone.sources import datagen, textio
from lodestone.streaming.scoring import assign_stream


def put(tmp_path, text):
    path = tmp_path / "in.txt"
    path.write_text(text)
    return str(path)


def features(df):
    return [r["features"] for r in df.orderBy("id").collect()]


SQUARE = [[0.0, 0.0], [1.0, 1.0], [5.0, 5.0], [6.0, 6.0]]


def test_dimension_major(spark, tmp_path):
    read = textio.read_kmeans(spark, put(tmp_path, "4 2 2 10\n0.0 0.0\n5.0 5.0\n0 1 5 6\n0 1 5 6\n"), "F1")
    assert (read.n, read.d, read.k, read.max_iters) == (4, 2, 2, 10)
    assert features(read.points) == SQUARE
    fitted = kmeans.fit(read.points, read.centroids, read.max_iters)
    assert fitted.centroids == [[0.5, 0.5], [5.5, 5.5]]


def test_row_major_and_strided(spark, tmp_path):
    rows = "\n".join(" ".join(map(str, v)) for v in SQUARE)
    assert features(textio.read_kmeans(spark, put(tmp_path, f"4 2 1 5\n9 9\n{rows}\n"), "F2").points) == SQUARE
    strided = textio.read_kmeans(spark, put(tmp_path, f"4 2 2 5\n{rows}\n"), "F3")
    assert strided.centroids == [[0.0, 0.0], [5.0, 5.0]]
    with pytest.raises(ValueError, match="layout"):
        textio.read_kmeans(spark, put(tmp_path, f"4 2 1 5\n9 9\n{rows}\n"), "F9")


def test_round_trip(spark, tmp_path):
    points = datagen.kmeans_points(spark, 50, 3)
    start = kmeans.init_strided(points, 4)
    for layout, write in (("F1", textio.write_f1), ("F2", textio.write_f2)):
        write(spark, str(tmp_path / layout), points, start, 7)
        read = textio.read_kmeans(spark, str(tmp_path / layout), layout)
        assert features(read.points) == features(points)
        assert (read.centroids, read.max_iters) == (start, 7)
    fitted = kmeans.fit(points, start, 3)
    labels = fitted.labels(points)
    textio.write_f4(spark, str(tmp_path / "F4"), fitted.centroids, labels)
    assert textio.read_centroids(spark, str(tmp_path / "F4"), 4) == [[pytest.approx(v, abs=1e-6) for v in c] for c in fitted.centroids]
    assert sorted(map(tuple, textio.read_labels(spark, str(tmp_path / "F4"), 4).collect())) == sorted(map(tuple, labels.collect()))


def test_knn_files(spark, tmp_path):
    points = datagen.knn_points(spark, 40)
    textio.write_f5(spark, str(tmp_path / "F5"), 3, [0.5, 0.5], points)
    read = textio.read_knn(spark, str(tmp_path / "F5"))
    assert (read.k, read.n, read.d, read.target) == (3, 40, 2, [0.5, 0.5])
    assert features(read.points) == features(points)
    near = knn.neighbors(read.points, read.target, read.k)
    textio.write_f6(str(tmp_path / "F6"), near, read.points, knn.vote(near))
    out = [r["value"] for r in textio.lines(spark, str(tmp_path / "F6")).orderBy("line_no").collect()]
    assert len(out) == 4 and out[-1] == f"classifed class:{knn.vote(near).first()[0]}"
    nearest = near.join(points.select("id", "features"), "id").orderBy("rank").first()
    assert out[0] == "".join(f"{x:.10f} " for x in nearest["features"]) + f"label: {nearest['label']}"
    textio.write_coordinates(str(tmp_path / "co"), near, read.points)
    assert textio.lines(spark, str(tmp_path / "co")).count() == 3
    textio.write_f7(str(tmp_path / "F7"), knn.result_line(near))
    winner, ids = (r["value"] for r in textio.lines(spark, str(tmp_path / "F7")).orderBy("line_no").collect())
    assert ids.split() == [str(r["id"]) for r in near.orderBy("rank").collect()]


def test_missing_file(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        textio.read_knn(spark, "/nowhere/at/all")


def test_classes_may_be_words(spark, tmp_path):
    read = textio.read_knn(spark, put(tmp_path, "1\n2 2\n0 0\n1 1 iris setosa\n"[:-7] + "\n2 2 rose\n"), "string")
    assert [(r["id"], r["features"], r["label"]) for r in read.points.orderBy("id").collect()] == [(0, [1.0, 1.0], "iris"), (1, [2.0, 2.0], "rose")]
    near = knn.neighbors(read.points, read.target, read.k)
    assert [r["label"] for r in near.collect()] == ["iris"]


@pytest.mark.parametrize("size", ["64", "1000000"])
def test_lines_of_many_splits(spark, tmp_path, size):
    """Numbers follow the file, however it is split, blank lines left out."""
    for part in range(3):
        (tmp_path / f"part-{part}.txt").write_text("".join(f"{part} {i}\n" + "\n" * (i % 3) for i in range(100)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = textio.lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["line_no"] for r in got] == list(range(300))
    assert sorted(r["value"] for r in got) == sorted(f"{p} {i}" for p in range(3) for i in range(100))
    for a, b in zip(got, got[1:], strict=False):
        if a["value"].split()[0] == b["value"].split()[0]:
            assert int(a["value"].split()[1]) + 1 == int(b["value"].split()[1])


def test_generated_files_run(spark, tmp_path):
    datagen.kmeans_file(spark, str(tmp_path / "F1"), 80, 2, 3, 9, seed=3)
    read = textio.read_kmeans(spark, str(tmp_path / "F1"), "F1")
    rows = features(read.points)
    assert (len(rows), read.d, read.k, read.max_iters) == (80, 2, 3, 9) and all(c in rows for c in read.centroids)
    assert kmeans.fit(read.points, read.centroids, 2).iterations in (1, 2)
    datagen.knn_file(spark, str(tmp_path / "F5"), 60, 3, 4, 2, seed=3)
    again = textio.read_knn(spark, str(tmp_path / "F5"))
    assert (again.k, again.n, again.d, len(again.target)) == (4, 60, 3, 3)
    assert knn.neighbors(again.points, again.target, again.k).count() == 4


def test_generators_dont_depend_on_partitions(spark):
    a = datagen.knn_points(spark, 100, 2, 3, seed=5)
    assert sorted(map(str, a.collect())) == sorted(map(str, a.repartition(7).collect()))
    assert {r["label"] for r in a.collect()} == {0, 1, 2}


def test_stream_scoring(spark, tmp_path):
    points = datagen.kmeans_points(spark, 60)
    points.write.parquet(str(tmp_path / "in"))
    centroids = [[-500.0, 0.0], [500.0, 0.0]]
    assign_stream(spark, str(tmp_path / "in"), "id bigint, features array<double>", centroids, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, kmeans.assign(points, centroids).select("id", "cluster_id").collect()))
