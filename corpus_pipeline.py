"""A training corpus from documents: quality rules, language, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each result as
Parquet in the shared folder and reads it again. All but the last return documents' own columns. Quality and benchmark
stages judge rows, named by id and text, so null and repeated ids are no exception; of rows equal in id and text, the
duplicate stage keeps one. Near duplicates go by id alone: there, a row without a doc_id stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import by_ids, discard, scratch, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: words a shingle, and the similarity as a fraction.
SHINGLE, SIMILAR = 5, (80, 100)
#: Pieces of text that a tokenizing worker remembers: few, as the stages before have used the executors' memory.
REMEMBERED = 200_000


#: Row keys (some 100 bytes each in Spark's table) up to which a set of them is broadcast.
BROADCAST_KEYS = 200_000


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """docs plus row_key: equal for rows of equal doc_id and columns (by 128 bits of hash)."""
    parts = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    hashes = [F.hex(F.xxhash64(F.lit(seed), *parts)) for seed in (1, 2)]
    return docs.select(*COLUMNS, F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *hashes).alias("row_key"))


def _without_rows(keyed: DataFrame, rejected: DataFrame) -> DataFrame:
    """keyed without the rejected row_keys."""
    keys = written(rejected.select(F.col("row_key").alias("id")).distinct(), "rejected")
    return by_ids(keyed, "row_key", keys, "left_anti", BROADCAST_KEYS).select(*COLUMNS)


def _without_repeats(docs: DataFrame) -> DataFrame:
    """docs with one row of those equal in doc_id and text."""
    keyed = _keyed(docs, "text")
    repeated = written(keyed.groupBy(F.col("row_key").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "repeated")
    if not repeated.count():
        return docs.select(*COLUMNS)
    rest = by_ids(keyed, "row_key", repeated, "left_anti", BROADCAST_KEYS).select(*COLUMNS)
    held = by_ids(keyed, "row_key", repeated, "left_semi", BROADCAST_KEYS).groupBy("row_key").agg(F.min(F.struct(*COLUMNS)).alias("r"))
    return rest.unionByName(held.select("r.*"))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the rejected ids."""
    ids = written(rejected.select(F.col("doc_id").alias("id")).filter("id IS NOT NULL").distinct(), "rejected")
    return by_ids(docs.select(*COLUMNS), "doc_id", ids, "left_anti").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's fences reject go."""
    from lodestone.llm.quality_rules import quality_rules

    keyed = _keyed(docs, "text", "lang", "source")
    return _without_rows(keyed, quality_rules(keyed, ("row_key", "lang", "source")).filter("NOT kept"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, without a likeliest language, or that read like no learned language go. If there
    are no languages to learn, nothing can be judged and all stay."""
    from lodestone.llm import language_id as ppm

    model = ppm.train(docs.filter(~ppm.held_out(F.col("doc_id"))))
    if not model.languages:
        return docs.select(*COLUMNS)
    judged = ppm.identify(docs, model, keep=tuple(COLUMNS))
    return judged.filter(ppm.accepted()).select(*COLUMNS)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the least doc_id stays, and one row of those equal in id and text."""
    from lodestone.llm.ngram_join import jaccard_components

    docs = _without_repeats(docs)
    found = jaccard_components(docs, SHINGLE, *SIMILAR)
    return _without(docs, found.filter("component_id <> doc_id"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    from lodestone.llm.decontaminate import contamination

    keyed = _keyed(docs, "text")
    return _without_rows(keyed, contamination(keyed, table(spark, sf_dir, "benchmark"), "row_key").filter("contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of what is left, with its sequence and place."""
    import public_tokenizers

    from lodestone.llm.packing import pack

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), "byte", end_id=0, remembered=REMEMBERED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("ngram_join", duplicate_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Language models and packing aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch():  # what the stage wrote on its way goes with it
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", lasting=True)
        if last is not None:
            discard(last)
        last = docs
    return docs
