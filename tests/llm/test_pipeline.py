import zlib

import numpy as np

import corpus_pipeline
from lodestone.llm import language_id, oracles
from tests.llm.conftest import DOCS, prose
from tests.llm.test_language_id import bits_of, tree
from tests.llm.test_packing import check
from tests.oracle import SMALL, ask


def by_language(docs):
    """Whether each document reads like a learned language, from dictionaries of counts."""
    own = [zlib.crc32(str(i).encode()) % 5 != 0 and lang is not None for i, lang in zip(docs["doc_id"], docs["lang"])]
    langs = sorted({lang for lang, learned in zip(docs["lang"], own) if learned})
    trees = [tree([t.encode() for t, lang, learned in zip(docs["text"], docs["lang"], own) if learned and lang == x and t]) for x in langs]
    for text in docs["text"]:
        if not any(c.isalpha() for c in text or ""):
            yield False
            continue
        bits = np.array([bits_of(t, text.encode()) for t in trees])
        share = 1 / np.exp2(np.maximum(bits.min() - bits, -1000)).sum()
        yield bool(share >= 0.5 and bits.min() / len(text.encode()) <= language_id.FOREIGN_BITS)


def test_each_stage_equals_brute_force_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), name)
        if name == "packing":
            check(docs.collect(), dict(zip(before["doc_id"], before["text"])))
            continue
        assert docs.columns == columns
        if name == "quality_rules":
            kept = ask(f"WITH {oracles.quality_sql()} SELECT doc_id FROM judged WHERE kept", documents=before)
        elif name == "ngram_join":
            kept = ask(f"WITH RECURSIVE {oracles.jaccard_sql(n=5, p=80)} SELECT doc_id FROM linked WHERE doc_id = component_id", documents=before)
        elif name == "decontamination":
            kept = ask(f"WITH {oracles.decontamination_sql()} SELECT doc_id FROM contaminations WHERE NOT contaminated", documents=before)
        else:
            kept = before[[told for told in by_language(before)]]
        assert sorted(kept["doc_id"]) == sorted(r["doc_id"] for r in docs.collect()), name
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == {i: t for i, t in zip(before["doc_id"], before["text"]) if i in set(kept["doc_id"])}


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SMALL)) == key(docs)


def test_stages_take_odd_rows_and_empty_tables(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SMALL)
        assert out.count() > 0, name
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        assert stage(spark, empty, SMALL).count() == 0


def test_rows_are_judged_and_not_their_ids(spark):
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    left = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    good, more = prose(1, 80), prose(2, 80)
    kept = corpus_pipeline.quality_stage(spark, frame([(1, good), (1, "too short"), (None, "too short"), (None, more)]), SMALL)
    assert left(kept) == sorted([(1, good), (None, more)], key=str)
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").filter("length(text) > 100").first()["text"]
    kept = corpus_pipeline.benchmark_stage(spark, frame([(1, good), (1, item), (None, item), (None, more)]), SMALL)
    assert left(kept) == sorted([(1, good), (None, more)], key=str)
    kept = corpus_pipeline.duplicate_stage(spark, frame([(1, good), (1, good), (None, more), (None, more), (2, prose(3, 80))]), SMALL)
    assert left(kept) == sorted([(1, good), (None, more), (2, prose(3, 80))], key=str)
