import random

import pytest

from lodestone.operators import kmeans, metrics
from lodestone.sources import datagen


def points(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, features array<double>")


def lloyd(vectors, centroids, iters):
    """Plain Python: labels against the centroids before the last update."""
    for _ in range(iters):
        labels = [min(range(len(centroids)), key=lambda j, v=v: (sum((a - b) ** 2 for a, b in zip(v, centroids[j])), j)) for v in vectors]
        new = []
        for j, old in enumerate(centroids):
            own = [v for v, at in zip(vectors, labels) if at == j]
            new.append([sum(x) / len(own) for x in zip(*own)] if own else old)
        moved = sum(abs(a - b) for x, y in zip(centroids, new) for a, b in zip(x, y))
        centroids = new
        if moved < 1e-6:
            break
    return labels, centroids


def labels_of(df):
    return [r["cluster_id"] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize(("d", "k"), [(2, 4), (1, 3), (20, 8)])
def test_fit_equals_plain_lloyd(spark, d, k):
    rng = random.Random(d)
    vectors = [[rng.uniform(-9, 9) for _ in range(d)] for _ in range(120)]
    df, start = points(spark, vectors), vectors[:k]
    labels, centroids = lloyd(vectors, start, 4)
    fitted = kmeans.fit(df, start, 4)
    assert labels_of(fitted.labels(df)) == labels
    assert all(a == pytest.approx(b) for x, y in zip(fitted.centroids, centroids) for a, b in zip(x, y))
    pruned, assigned = kmeans.fit_pruned(df, start, 4)
    assert labels_of(assigned) == labels
    assert pruned.centroids == fitted.centroids


def test_plain_tie_goes_to_the_lowest_and_pruned_tie_to_the_old(spark):
    df = points(spark, [[0.0]])
    centroids = [[1.0], [-1.0]]
    assert labels_of(kmeans.assign(df, centroids)) == [0]
    old = df.selectExpr("id", "features", "1 AS old_label")
    row = kmeans.assign_pruned(old, centroids).first()
    assert (row["cluster_id"], row["compared"], row["skipped"]) == (1, 2, 0)


def test_far_centroids_are_skipped(spark):
    old = points(spark, [[0.1]]).selectExpr("id", "features", "0 AS old_label")
    row = kmeans.assign_pruned(old, [[0.0], [100.0]]).first()
    assert (row["cluster_id"], row["compared"], row["skipped"]) == (0, 1, 1)


def test_empty_cluster_keeps_its_centroid(spark):
    fitted = kmeans.fit(points(spark, [[0.0], [1.0]]), [[0.5], [99.0]], 3)
    assert fitted.centroids == [[0.5], [99.0]]
    assert fitted.iterations == 1


def test_one_iteration_labels_with_the_first_centroids(spark):
    df = points(spark, [[0.0], [1.0], [9.0]])
    fitted = kmeans.fit(df, [[0.0], [1.0]], 1)
    assert labels_of(fitted.labels(df)) == [0, 1, 1]
    assert fitted.centroids == [[0.0], [5.0]]
    with pytest.raises(ValueError, match="at least 1"):
        kmeans.fit(df, [[0.0]], 0)


def test_strided_start(spark):
    df = points(spark, [[float(i)] for i in range(11)])
    assert kmeans.init_strided(df, 3) == [[0.0], [3.0], [6.0]]
    with pytest.raises(ValueError, match="between 1"):
        kmeans.init_strided(df, 12)
    repeated = spark.createDataFrame([(7, [float(i)]) for i in range(9)] + [(1, [50.0])] * 2, "id bigint, features array<double>").repartition(4)
    got = kmeans.init_strided(repeated, 5)
    assert len(got) == 5 and got[0] == [50.0] and len({v for (v,) in got[1:]}) == 4
    assert got == kmeans.init_strided(repeated.repartition(2), 5)


def test_plus_plus_is_seeded_and_stops_at_distinct_points(spark):
    df = datagen.kmeans_points(spark, 200, 2)
    assert kmeans.plus_plus_init(df, 4, 1) == kmeans.plus_plus_init(df, 4, 1)
    assert len(kmeans.plus_plus_init(points(spark, [[1.0], [1.0]]), 3)) == 1


def test_agreement_and_sizes(spark):
    a = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id bigint, cluster_id int")
    b = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id bigint, cluster_id int")
    assert metrics.label_agreement(a, b).first()[0] == pytest.approx(2 / 3)
    assert metrics.label_agreement(a.limit(0), b).first()[0] is None
    assert {tuple(r) for r in kmeans.cluster_sizes(a).collect()} == {(0, 1), (1, 2)}
