import pytest

from lodestone.functions import vectors
from lodestone.operators import kmeans, knn


def points(spark, rows):
    return spark.createDataFrame(rows, "id bigint, features array<double>, label int")


TIED = [(3, [1.0, 0.0], 0), (1, [0.0, 1.0], 1), (2, [-1.0, 0.0], 0), (4, [5.0, 5.0], 1)]


def test_ties_at_the_last_place(spark):
    df = points(spark, TIED)
    assert [r["id"] for r in knn.neighbors(df, [0.0, 0.0], 2).orderBy("rank").collect()] == [1, 2]
    assert [r["id"] for r in knn.neighbors(df, [0.0, 0.0], 2, "label").orderBy("rank").collect()] == [2, 3]


@pytest.mark.parametrize("k", [4, 9])
def test_k_up_to_and_over_n(spark, k):
    assert knn.neighbors(points(spark, TIED), [0.0, 0.0], k).count() == 4


def test_votes(spark):
    rows = [(1, [0.1], 7), (2, [0.2], 3), (3, [0.3], 7), (4, [0.4], 3), (5, [0.5], 9)]
    near = knn.neighbors(points(spark, rows), [0.0], 5)
    assert tuple(knn.vote(near).first()) == (3, 2)
    assert tuple(knn.vote(near, "nearest").first()) == (7, 2)
    assert tuple(knn.result_line(near).first()) == (7, "1 2 3 4 5")


def test_vote_of_nobody(spark):
    none = knn.neighbors(points(spark, []), [0.0], 5)
    assert tuple(knn.vote(none).first()) == (-1, 0)


def test_ranking_is_a_permutation(spark):
    df = points(spark, [(i, [float(i * 7 % 13), float(i % 3)], 0) for i in range(200)])
    ranks = knn.full_ranking(df.repartition(7), [1.0, 1.0]).toPandas().sort_values("rank")
    assert ranks["rank"].tolist() == list(range(1, 201))
    expected = sorted(range(200), key=lambda i: ((i * 7 % 13 - 1) ** 2 + (i % 3 - 1) ** 2, i))
    assert ranks["id"].tolist() == expected
    far = knn.farthest(df, [1.0, 1.0], 3).orderBy("rank")
    assert [r["id"] for r in far.collect()] == expected[::-1][:3]


def test_selfcheck(spark):
    df = points(spark, TIED)
    assert knn.selfcheck(df, [0.0, 0.5], knn.neighbors(df, [0.0, 0.5], 3)).first()[0] == 0


def test_dimension_check(spark):
    df = points(spark, [(1, [1.0], 0), (2, [1.0, 2.0], 0)])
    with pytest.raises(Exception, match="without 2 elements"):
        vectors.require_dimension(df, 2).collect()


def test_scratch_tables_go(spark):
    from pathlib import Path

    from lodestone import session

    there = lambda t: Path(t.written_path.removeprefix("file://")).exists()
    with session.scratch():
        outer = session.written(spark.range(2), "t")
        with session.scratch():
            inner, kept = session.written(spark.range(3), "t"), session.written(spark.range(4), "t", lasting=True)
        assert not there(inner) and there(kept) and kept.count() == 4
        last = session.written(spark.range(5), "t", lasting=True)
    assert not there(outer) and not there(kept) and there(last)
    session.discard(last)


def test_missing_target(spark):
    with pytest.raises(LookupError):
        vectors.vector_of(points(spark, TIED), 99)


def test_topk_plans_without_a_full_sort(spark):
    plan = knn.neighbors(points(spark, TIED), [0.0, 0.0], 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_ranking_of_equal_points(spark):
    """All distances equal: ranks go by id, in several partitions."""
    df = points(spark, [(i, [1.0], 0) for i in range(500)]).repartition(5)
    assert [(r["rank"], r["id"]) for r in knn.full_ranking(df, [0.0]).orderBy("rank").collect()] == [(i + 1, i) for i in range(500)]


@pytest.mark.parametrize("broken", [None, [1.0], [1.0, 2.0, 3.0]])
def test_a_point_without_its_vector_fails(spark, broken):
    df = points(spark, [(1, [1.0, 1.0], 0), (2, broken, 0)])
    for found in (knn.neighbors(df, [0.0, 0.0], 1), knn.distances(df, [0.0, 0.0]), knn.farthest(df, [0.0, 0.0], 1), kmeans.assign(df, [[0.0, 0.0]]), kmeans.distance_matrix(df, [[0.0, 0.0]] * 80)):
        with pytest.raises(Exception, match="without 2 elements"):
            found.collect()


@pytest.mark.parametrize("block", [2, 1000])
def test_many_queries(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(knn, "BLOCK", block)
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(4)), float(rng.randrange(4))], 0) for i in range(150)]  # many ties
    df = points(spark, rows).repartition(6)
    asked = df.filter("id % 30 = 0")
    for alone in (True, False):
        got = [(r["query_id"], r["rank"], r["id"], r["distance"]) for r in knn.neighbors_of_many(df, asked, 7, alone).orderBy("query_id", "rank").collect()]
        expected = []
        for q, t, _ in rows[::30]:
            best = sorted((sum((a - b) ** 2 for a, b in zip(t, v)), i) for i, v, _ in rows if not (alone and i == q))[:7]
            expected += [(q, rank, i, d**0.5) for rank, (d, i) in enumerate(best, 1)]
        assert got == expected
    assert knn.neighbors_of_many(df, df.limit(0), 3).count() == 0
    assert knn.neighbors_of_many(df.filter("id < 3"), asked, 9).filter("query_id = 30").count() == 3
