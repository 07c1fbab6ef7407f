import numpy as np
import pytest

from lodestone.llm import oracles, quality_rules
from lodestone.llm.queries import op6_quality_rules
from tests.llm.conftest import prose
from tests.oracle import SMALL, ask, same


def counts(text):
    return dict(zip(quality_rules.COUNTS, quality_rules.count_text(None if text is None else np.frombuffer(text.encode(), np.uint8)), strict=True))


def test_query_equals_sql(spark):
    same(op6_quality_rules(spark, SMALL).toPandas(), ask(oracles.oracle_sql()["op6_quality_rules"]))


def test_odd_rows_equal_sql(spark, odd):
    rows = odd.filter("doc_id IS NOT NULL AND doc_id <> 8").select("doc_id", "text", "lang", "source")
    made = quality_rules.quality_rules(odd)
    assert made.count() == odd.count()
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    sql = f"WITH {oracles.quality_sql()} SELECT {', '.join(columns)} FROM judged"
    same(quality_rules.quality_rules(rows).select(*columns).toPandas(), ask(sql, documents=rows.toPandas()))


def test_counts():
    c = counts("a b\n\na b\n x#\r\n!Ü")
    assert (c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_lines"], c["n_shout"]) == (6, 8, 1, 1, 4, 1)
    assert set(counts(None).values()) == set(counts("").values()) == {0}


@pytest.mark.parametrize("seed", range(5))
def test_repeated_words_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{x}" for x in rng.integers(0, 2 + seed, 60)] + prose(seed, 30).split() * 2
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + j for i, g in enumerate(windows) if windows.count(g) > 1 for j in range(8)}
    assert counts(" ".join(words))["n_repeat_words"] == len(covered)


def test_groups_have_their_own_thresholds(spark):
    """Symbols are usual in one source, and out of the ordinary in the other."""
    plain = [(i, prose(i, 50), "en", "plain", 0) for i in range(150)]
    marked = [(1000 + i, " ".join(w + "##" for w in prose(i, 50).split()), "en", "code", 0) for i in range(150)]
    stray = [(5000, " ".join(w + "##" for w in prose(7, 50).split()), "en", "plain", 0)]
    docs = spark.createDataFrame(plain + marked + stray, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs).collect()}
    assert not kept.pop(5000)
    assert all(kept.values())


def test_sketches_merge(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rated = quality_rules.with_rates(quality_rules.text_counts(docs))
    cells = lambda df: sorted(map(str, quality_rules.sketches(df).collect()))
    assert cells(rated) == cells(rated.repartition(5))


def test_empty(spark, empty):
    assert quality_rules.quality_rules(empty).count() == 0
