"""One thin query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id as ppm

    docs = table(spark, sf_dir, "documents")
    model = ppm.train(docs.filter(~ppm.held_out(F.col("doc_id"))))
    found = ppm.identify(docs, model)
    return found.select("doc_id", ppm.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_classifier as qda
    from .language_id import remainder

    featured = written(qda.document_features(table(spark, sf_dir, "documents")), "features")
    apart = remainder(F.col("doc_id"), 4) == 2
    labels = table(spark, sf_dir, "labels").filter(~apart).select("doc_id", F.col("quality").alias("label"))
    model = qda.fit(featured.join(labels, "doc_id"))
    return qda.score(featured, model).select("doc_id", apart.alias("held_out"), "score", "predicted")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "byte", end_id=0)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_store

    docs = table(spark, sf_dir, "documents")
    return token_store.read(token_store.write(docs, public_tokenizers.path("word_bpe_49k.json"), "word", end_id=1))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n=3, p=90, q=100)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.read(warc.write(table(spark, sf_dir, "pages"))).drop("url")


#: The rules of op8, fixed by its contract.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages"), URL_RULES).drop("mined_rule")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))
