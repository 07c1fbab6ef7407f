"""Quality rules with thresholds taken from mergeable quantile sketches per language and source.

1. A pass over the whole texts yields counts per document, a written table of numbers.
2. Every rate is put into a histogram sketch: bins of integer values whose width doubles with their magnitude
   (HIGH_BITS leading bits kept, so a quantile is off by less than 1 / 2**(HIGH_BITS - 1) of its value). Two
   sketches merge by adding counts, so the partial sums before the shuffle are the sketches of the tasks, a
   source's sketches add up to its language's, and a hot source costs one row per bin and task.
3. Quantiles of a sketch give fences for its (language, source), REACH interquartile ranges beyond the quartiles; a
   group of fewer than MIN_DOCS documents uses its language's sketch, and a small language the whole corpus's. No
   fence has a constant of its own: where most documents of a group have none of something, its fence is 0.
4. The fences are joined back and filter. ALLOWED occurrences beyond a fence are always chance, in a text of any
   length: without that, a group in which a rate is always 0 would reject its first exception.

Documents that fail the base rules don't enter the sketches. Defined results: null or empty text has no words
and fails the base; null lang or source is a group of its own; repeated rows are judged alike; an empty table
gives an empty result; clashing names in extra columns do no harm, as only the named columns are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, utf8_views, written
from .textkernel import SPACE, ngrams, spans, word_hashes

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
MIN_DOCS = 100
#: Groups (some 200 bytes each) up to which their fences are broadcast; beyond it, the join is a shuffled one, alone on
#: its exchanges, which adaptive execution splits at a hot source.
FENCES = 50_000
HIGH_BITS = 6
#: Interquartile ranges beyond the quartile at which a rate is out of the ordinary for its group.
REACH = 6
#: Occurrences beyond a fence that are still chance.
ALLOWED = 3
#: Rates in thousandths: what occurs, and of what.
RATES = {"symbol_rate": ("n_symbols", "word_chars"), "upper_rate": ("n_upper", "word_chars"), "shout_rate": ("n_shout", "n_words"), "dup_line_rate": ("n_dup_lines", "n_lines"), "stutter_rate": ("n_stutter", "n_words")}
#: A level, fenced on either side, in hundredths of characters.
LENGTH = "word_length"
MEASURES = {k: f"1000 * {count} div {base}" for k, (count, base) in RATES.items()} | {LENGTH: "100 * word_chars div n_words"}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shout", "n_stutter")
#: Characters counted as symbols, and as shouting.
SYMBOLS, SHOUT = b"#*$%&|<>", b"!"

_IS_SYMBOL, _IS_UPPER, _IS_SHOUT, _STARTS_CHAR = (np.zeros(256, bool) for _ in range(4))
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_SHOUT[list(SHOUT)] = True
_IS_UPPER[0x41:0x5B] = True
_STARTS_CHAR[:] = (np.arange(256) & 0xC0) != 0x80


def repeated_words(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows found twice or more. Equal hashes are confirmed by the words themselves."""
    grams = ngrams(hashes, window)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return 0
    suspects = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    raw = text.tobytes()
    found: dict[tuple, list[int]] = {}
    for i in suspects.tolist():
        found.setdefault(tuple(raw[starts[j] : ends[j]] for j in range(i, i + window)), []).append(i)
    covered = np.zeros(len(starts) + 1, np.int64)
    for places in found.values():
        if len(places) > 1:
            at = np.asarray(places)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def count_text(text: np.ndarray | None) -> tuple[int, ...]:
    """The COUNTS of one text."""
    if text is None or not len(text):
        return (0,) * len(COUNTS)
    starts, ends = spans(text)
    hashes = word_hashes(text, starts, ends)
    chars = int((_STARTS_CHAR[text] & ~SPACE[text]).sum())
    lines = [x for x in text.tobytes().split(b"\n") if not SPACE[np.frombuffer(x, np.uint8)].all()]
    histogram = np.bincount(text, minlength=256)
    return (
        len(starts), chars, int(histogram[_IS_SYMBOL].sum()), len(lines) - len(set(lines)), repeated_words(text, starts, ends, hashes),
        len(lines), int(histogram[_IS_UPPER].sum()), int(histogram[_IS_SHOUT].sum()), int((hashes[1:] == hashes[:-1]).sum()),
    )


def text_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The kept columns and the COUNTS of every document's text."""
    schema = pa.schema([pa.field(c, pa.int64()) for c in COUNTS])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = np.array([count_text(x) for x in utf8_views(batch.column("text"))], np.int64).reshape(-1, len(COUNTS))
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], names=[*keep, *schema.names])

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    return map_arrow(docs.select(*keep, "text"), batches, ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{c} bigint" for c in COUNTS)]))


def bin_sql(value: str) -> str:
    """The lower edge of a value's bin: exact below 2**HIGH_BITS."""
    cases = " ".join(f"WHEN {value} < {1 << (HIGH_BITS + s)} THEN {value} div {1 << s} * {1 << s}" for s in range(1, 24))
    return f"CASE WHEN {value} < {1 << HIGH_BITS} THEN {value} {cases} ELSE {1 << (HIGH_BITS + 24)} END"


def with_rates(counts: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rates = {k: F.when(F.col("n_words") > 0, F.expr(sql)).otherwise(F.lit(0)).cast("bigint") for k, sql in MEASURES.items()}
    return counts.withColumn("base_failed", failed).withColumns(rates)


def sketches(rated: DataFrame) -> DataFrame:
    """(lang, source, rate, bin, n): a mergeable sketch of each rate in each group."""
    pairs = F.array(*[F.struct(F.lit(k).alias("rate"), F.expr(bin_sql(k)).cast("bigint").alias("bin")) for k in MEASURES])
    cells = rated.filter(~F.col("base_failed")).select("lang", "source", F.inline(pairs))
    return cells.groupBy("lang", "source", "rate", "bin").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame) -> DataFrame:
    """Sketches of groups, of languages and of the corpus: (level, lang, source, rate, bin, n)."""
    by_lang = sketch.groupBy("lang", "rate", "bin").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "rate", "bin", "n")
    whole = sketch.groupBy("rate", "bin").agg(F.sum("n").alias("n")).select(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "rate", "bin", "n")
    return sketch.select(F.lit(0).alias("level"), "lang", "source", "rate", "bin", "n").unionByName(by_lang).unionByName(whole)


def fences(levels: DataFrame) -> DataFrame:
    """(level, lang, source, docs, hi_<rate>, lo_<rate>) from each sketch's quartiles."""
    # a sketch has at most 24 * 2**HIGH_BITS bins, whatever it counted
    groups = levels.groupBy("level", "lang", "source", "rate").agg(F.sum("n").alias("docs"), F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))

    def quantile(percent: int) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("at"))
        step = lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.when(acc["at"].isNull() & (100 * (acc["seen"] + x["n"]) >= percent * F.col("docs")), x["bin"]).otherwise(acc["at"]).alias("at"))
        return F.aggregate("bins", zero, step)["at"]

    q = groups.select("level", "lang", "source", "rate", "docs", quantile(25).alias("q25"), quantile(50).alias("q50"), quantile(75).alias("q75"))
    # a level's spread is at least what its sketch resolves
    least = F.when(F.col("rate") == LENGTH, F.expr(f"q50 div {1 << (HIGH_BITS - 1)} + 1")).otherwise(F.lit(0))
    reach = REACH * F.greatest(F.col("q75") - F.col("q25"), least)
    q = q.withColumn("hi", F.col("q75") + reach).withColumn("lo", F.col("q25") - reach)
    picks = [F.max(F.when(F.col("rate") == k, F.col("hi"))).alias(f"hi_{k}") for k in MEASURES]
    picks.append(F.max(F.when(F.col("rate") == LENGTH, F.col("lo"))).alias(f"lo_{LENGTH}"))
    return q.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *picks)


def judge(rated: DataFrame, levels: DataFrame) -> DataFrame:
    """rated plus kept: within the fences of the smallest level with enough documents."""
    limits = [*(f"hi_{k}" for k in MEASURES), f"lo_{LENGTH}"]
    packed = levels.select("level", "lang", "source", F.struct("docs", *limits).alias("f"))
    group, lang, whole = (packed.filter(F.col("level") == i).drop("level") for i in range(3))
    lang, whole = lang.drop("source").withColumnRenamed("f", "f1"), whole.drop("lang", "source").withColumnRenamed("f", "f2")
    # fences of groups, each with its fallbacks: a row per (lang, source)
    g = group.alias("g").join(lang.alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang")), "left").crossJoin(F.broadcast(whole))  # whole has one row
    enough = lambda c: F.col(c)["docs"] >= MIN_DOCS
    chosen = g.select(F.col("g.lang").alias("_lang"), F.col("g.source").alias("_source"), F.when(enough("f"), F.col("f")).when(enough("f1"), F.col("f1")).otherwise(F.col("f2")).alias("f"))
    chosen = written(chosen, "fences")
    if chosen.count() <= FENCES:
        chosen = F.broadcast(chosen)
    joined = rated.join(chosen, rated["lang"].eqNullSafe(chosen["_lang"]) & rated["source"].eqNullSafe(chosen["_source"]), "left")
    within = ~F.col("base_failed")
    for k, (count, base) in RATES.items():
        within &= 1000 * (F.col(count) - ALLOWED) <= F.col(f"f.hi_{k}") * F.col(base)
    within &= F.col(LENGTH).between(F.col(f"f.lo_{LENGTH}"), F.col(f"f.hi_{LENGTH}"))
    return joined.withColumn("kept", F.coalesce(within, F.lit(False))).drop("_lang", "_source", "f")


def quality_rules(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """(keep, COUNTS, base_failed, rates, kept), one row for each row of docs (text and keep, lang and source among it)."""
    rated = with_rates(written(text_counts(docs, keep), "counts"))
    return judge(rated, fences(merged(sketches(rated))))
