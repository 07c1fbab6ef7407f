import pytest

from lodestone.llm import decontaminate, oracles
from lodestone.llm.queries import op3_decontaminate
from tests.llm.conftest import DOCS, prose
from tests.oracle import SMALL, ask, same

SQL = f"WITH {oracles.decontamination_sql()} SELECT * FROM contaminations"


def test_query_equals_sql(spark):
    got = op3_decontaminate(spark, SMALL).toPandas()
    assert got["contaminated"].any()
    same(got, ask(SQL))


ITEMS = [
    (1, prose(1, 30)), (2, prose(2, 13)), (3, "short item of six words here"), (4, "pair only"), (5, "single"), (6, None), (7, "... !!"), (8, prose(1, 30)),
    (10, "a a a a a a a a a a a a a a a"),
]


def documents():
    one, two = prose(1, 30).split(), prose(2, 13).split()
    return [
        (1, " ".join(one)), (2, "Before, " + " ".join(one[3:16]).upper() + "; after"), (3, " ".join(one[3:15])), (4, " ".join(two[:12])), (5, "x " * 300 + " ".join(two)),
        (6, "a SHORT item-of six.words here"), (7, "pair, only"), (8, "pair"), (9, "the single one"), (10, "a " * 40), (11, "a " * 12), (12, None), (13, ""), (14, "?!"),
        (15, " ".join(one[:20] + one[:20])), (16, prose(77, 50)), (17, "é" + " ".join(two)), (18, " ".join(two) + " pair only " + " ".join(one)),
    ]


@pytest.mark.parametrize(("limit", "keys"), [(0, 0), (0, 1000), (100_000, 0), (100_000, 1000)])
def test_cases_equal_sql(spark, monkeypatch, limit, keys):
    """Broadcast and shuffled joins."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(decontaminate, "KEYS", keys)
    docs = spark.createDataFrame(documents(), "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    same(decontaminate.contamination(docs, items).toPandas(), ask(SQL, documents=docs.toPandas(), benchmark=items.toPandas()))


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(documents(), "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    plan = decontaminate.contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, prose(3, 60)), (None, "one"), (1, prose(3, 60))], "item_id bigint, text string").selectExpr("*", "1 AS size", "2 AS w", "'t' AS tokens")
    rows = decontaminate.contamination(odd, items).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[6]["contaminated"] and by_id[7]["n_hit"] == 60 and by_id[4]["n_hit"] == 1
    assert not by_id[1]["contaminated"]
    assert decontaminate.contamination(empty, items).count() == 0
    clean = decontaminate.contamination(odd, items.limit(0)).collect()
    assert len(clean) == odd.count() and not any(r["contaminated"] for r in clean)
    assert spark.createDataFrame([], DOCS).count() == 0


@pytest.mark.parametrize("limit", [0, 100_000])
def test_rows_are_judged_by_their_own_text(spark, monkeypatch, limit):
    """Null and shared ids, by brute force: every row as if it stood alone."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    texts = [t for _, t in documents()]
    rows = [(7 if i % 3 else None, t) for i, t in enumerate(texts + texts[:4])]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), items).collect()
    numbered = spark.createDataFrame(list(enumerate(t for _, t in rows)), "doc_id bigint, text string").toPandas()
    alone = ask(SQL, documents=numbered, benchmark=items.toPandas())
    ids = [i for i, _ in rows]
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = [(ids[r["doc_id"]], *(r[c] for c in columns)) for r in alone.to_dict("records")]
    assert sorted(map(str, ((r["doc_id"], *(r[c] for c in columns)) for r in got))) == sorted(map(str, expected))
    assert all(r["n_hit"] <= r["n_words"] for r in got)


def test_shuffled_joins_move_no_texts(spark, monkeypatch):
    """Nothing but numbers of documents is exchanged, in any query of the run."""
    import re

    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    moved = {}
    real = decontaminate.written

    def written(df, name, **more):
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        moved[name] = {c.split("#")[0].strip() for found in re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan) for c in found.split(",")}
        return real(df, name, **more)

    monkeypatch.setattr(decontaminate, "written", written)
    docs = spark.createDataFrame(documents(), "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        decontaminate.contamination(docs, items).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "shingle" in moved["frequencies"] and "shingle" in moved["places"]
    assert not (moved["frequencies"] | moved["places"]) & {"w", "text", "tokens"}


@pytest.mark.parametrize("limit", [0, 100_000])
def test_few_files_of_many_partitions(spark, monkeypatch, limit):
    """Tables on the way have no file for each of 211 shuffle partitions; the result is the same."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    files = {}
    real = decontaminate.written

    def written(df, name, **more):
        out = real(df, name, **more)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(decontaminate, "written", written)
    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    docs = spark.createDataFrame(documents(), "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = decontaminate.contamination(docs, items).toPandas()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    most = max(16, spark.sparkContext.defaultParallelism)
    assert {"windows", "shingles", "frequencies", "prefixes", "occurrences", "judged"} <= set(files)
    assert {k: n for k, n in files.items() if n > most} == {}
    same(got, ask(SQL, documents=docs.toPandas(), benchmark=items.toPandas()))
