import random

import numpy as np
import pytest

from lodestone.llm import components, ngram_join, oracles
from lodestone.llm.queries import op1_ngram_join
from tests.llm.conftest import DOCS, prose
from tests.oracle import SMALL, ask, same

SQL = f"WITH RECURSIVE {oracles.jaccard_sql()} SELECT * FROM linked"


def test_query_equals_sql(spark):
    same(op1_ngram_join(spark, SMALL).toPandas(), ask(oracles.oracle_sql()["op1_ngram_join"]))


def edited(text: str, changes: int, rng: random.Random) -> str:
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def family(seed: int, size: int, length: int, most: int) -> list[str]:
    rng = random.Random(seed)
    base = prose(seed, length)
    return [edited(base, rng.randrange(most + 1), rng) for _ in range(size)]


@pytest.mark.parametrize("crowd", [2, 6, 128])
def test_crowds_and_pairs_find_the_same_components(spark, monkeypatch, crowd):
    """Families of near copies around the threshold, one inside another, with copies and strangers."""
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    rng = random.Random(9)
    texts = family(1, 60, 150, 5) + family(2, 25, 80, 3) + [prose(100 + i, 50) for i in range(10)]
    branch = edited(prose(1, 150), 4, rng)
    texts += [edited(branch, rng.randrange(4), rng) for _ in range(20)] + texts[:5] + [t.upper() for t in texts[5:8]]
    docs = spark.createDataFrame([(3 * i % 1009, t, None, None, None) for i, t in enumerate(texts)], DOCS).repartition(4)
    same(ngram_join.jaccard_components(docs).toPandas(), ask(SQL, documents=docs.toPandas()))


def test_other_parameters(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(family(4, 40, 120, 8) + family(5, 20, 7, 2))], DOCS)
    sql = f"WITH RECURSIVE {oracles.jaccard_sql(n=5, p=80)} SELECT * FROM linked"
    same(ngram_join.jaccard_components(docs, 5, 80, 100).toPandas(), ask(sql, documents=docs.toPandas()))


def test_odd_rows(spark, odd, empty):
    rows = ngram_join.jaccard_components(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [by_id[i]["n_shingles"] for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1]
    assert [by_id[i]["component_id"] for i in (1, 2, 3, 4, 6, 7)] == [1, 2, 3, 4, 6, 6]
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None, None]
    assert ngram_join.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    expected = {x: find(x) for x in parent if find(x) != x}
    got = components.components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(3)).collect()
    assert {r["node"]: r["root"] for r in got} == expected


def test_no_edges(spark):
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def by_brute_force(rows, n=3, p=90, q=100):
    """(doc_id, size, component) of rows (doc_id, text): rows of one id are linked, null ids aren't."""
    def shingles(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, (x, a) in enumerate(zip(rows, sets, strict=True)):
        for j, (y, b) in enumerate(zip(rows[:i], sets, strict=False)):
            if a and b and x[0] is not None and y[0] is not None and (x[0] == y[0] or q * len(a & b) >= p * len(a | b)):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min(r[0] for r, h in zip(rows, group, strict=True) if h == g) for g in group if not any(r[0] is None for r, h in zip(rows, group, strict=True) if h == g)}
    return sorted(((r[0] is None, r[0] or 0), len(a), (r[0] is None, least.get(g) or 0)) for r, a, g in zip(rows, sets, group, strict=True))


def found(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], (r["component_id"] is None, r["component_id"] or 0)) for r in df.collect())


def test_shared_ids_of_different_texts(spark, monkeypatch):
    """Texts of one id lie in one component, and links of either text hold."""
    rng = random.Random(4)
    base, other = prose(50, 59), prose(51, 59)
    rows = [(5, base), (5, other), (9, edited(base, 1, rng)), (3, edited(other, 1, rng)), (8, prose(52, 30)), (8, ""), (None, base), (7, None), (7, prose(53, 40)), (6, prose(53, 40)), (6, prose(53, 40))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    expected = by_brute_force(rows)
    assert found(ngram_join.jaccard_components(frame)) == expected
    monkeypatch.setattr(ngram_join, "KEYS", 0)
    monkeypatch.setattr(ngram_join, "CROWD", 1)
    assert found(ngram_join.jaccard_components(frame)) == expected


@pytest.mark.parametrize("guests", [1, 3])
def test_runs_of_candidates(spark, monkeypatch, guests):
    monkeypatch.setattr(ngram_join, "GUESTS", guests)
    rows = [(i, t) for i, t in enumerate(family(6, 30, 100, 4) + family(7, 10, 60, 2))]
    assert found(ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))) == by_brute_force(rows)


def test_copies_are_found_without_moving_prefixes(spark):
    docs = ngram_join.keyed(spark.createDataFrame([(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "e f g"), (None, "a b c d"), (4, "")], "doc_id bigint, text string"))
    none = np.empty(0, np.uint64)
    named = ngram_join.classes(ngram_join.prefixes(docs, 3, 90, 100, none, none.astype(np.int64)))
    assert sorted((r["doc_id"], r["size"]) for r in named.collect()) == [(1, 2), (2, 1)]
    plan = named.select("cid", "first", "second")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_narrowed_sets_never_lose_a_common_token():
    rng = np.random.default_rng(3)
    sizes = (1, 40, ngram_join.NARROW, ngram_join.NARROW + 1, 300)
    for a in sizes:
        for b in sizes:
            x, y = (rng.integers(0, 2**64, n, np.uint64) for n in (a, b))
            y[-1] = x[0]
            assert ngram_join.share(ngram_join.narrowed(x), ngram_join.narrowed(y))
    apart = [np.array([t << 48], np.uint64) for t in (1, 2)]
    assert not ngram_join.share(*map(ngram_join.narrowed, apart))


def test_parts_of_postings_are_all_postings(spark):
    rows = [(1, 3, [5, -7, 9]), (2, 3, [9, -7, 11]), (3, 2, [-7, 12])]
    named = spark.createDataFrame(rows, "cid bigint, size bigint, first array<bigint>")
    often, count = np.array([9], np.uint64), np.array([1000])
    whole = sorted(ngram_join.postings(named, often, count).collect())
    assert len(whole) == 5
    assert sorted(r for part in range(3) for r in ngram_join.postings(named, often, count, part, 3).collect()) == whole
