"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of WINDOW consecutive words (the whole item if it has fewer). A window is a set of
shingles, runs of up to SHINGLE words; it occurs in a document only if all its shingles do, so for exact
containment one necessary token is prefix enough: its rarest shingle.

1. Documents are scanned once for the benchmark's shingles, which gives each shingle's frequency over all
   documents; shingles are ordered by it, rarest first, ties by hash.
2. Every window keeps its first shingle in that order and the shingle's place in the window.
3. A second scan joins document shingles to these prefixes. A match fixes where the window would have to begin.
   Length and position bounds (it must begin at a word and end within the document) go first, then the words there are
   hashed and, where 128 bits agree, compared themselves.
4. Words covered by occurrences are counted once each.

What is broadcast are rows of a few numbers (shingle, place, size, the window's hash), if they are counted to be at most
BROADCAST_ROWS. Beyond that, joins are shuffled: of documents, only (key, place, shingle) of each word moves, which
adaptive execution splits where a shingle is frequent, and places that a window may begin at join back to the texts by
key, broadcast up to KEYS texts.

Tables on the way are written by as many tasks as there are cores (TASKS at least), each of which sums its shuffle
partitions in turn. A file a partition can be hundreds of files of a few rows, and where Hadoop lacks its native library,
an executor starts processes (chmod) for each file in a local folder.

A text is known by a key of 128 bits of hash, so rows are judged by their own text, whatever their ids.

Defined results: null or empty text has no words, and such an item no windows; repeated items count as items of
their own with equal windows; an item with a null id hits words but isn't listed; rows that share a doc_id, null
included, are judged each by its own text; an empty benchmark hits nothing; ties in rarity don't change results; extra
columns are never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_ids, discard, scratch, written

WINDOW, SHINGLE = 13, 3
#: Rows of numbers (some 100 bytes each in Spark's table) up to which a table is broadcast.
BROADCAST_ROWS = 500_000
#: Texts with places to compare (some 200 bytes each) up to which these are broadcast.
KEYS = 200_000
#: Tasks, and so files, of a table on the way, unless the cluster has more cores.
TASKS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cases A-Z and splits; a separator at the start leaves no empty word."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def _shingle(tokens: Column, at: Column, n: int) -> Column:
    """Hash of n words from a position counted from 0."""
    return F.xxhash64(F.lit(n), *[tokens[at + j] for j in range(n)])


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, tokens, size): the distinct windows of each item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    each = items.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s") + 1, window).alias("tokens"))
    return each.distinct().withColumn("size", F.size("tokens"))


def text_key(text: Column) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(F.lit(seed), text, text.isNull()).alias(f"k{seed}") for seed in (1, 2)]


def _window_hash(tokens: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), tokens) for seed in (3, 4)]


def _shingles_of(table: DataFrame, tokens: str, lengths: list[int], *kept: str) -> DataFrame:
    """(kept, at, shingle) for each run of n words, n of lengths."""
    placed = table.select(*kept, tokens, F.posexplode(tokens).alias("at", "_word"))
    left = F.size(tokens) - F.col("at")
    runs = [F.when(left >= n, _shingle(F.col(tokens), F.col("at"), n)) for n in lengths]
    if len(runs) == 1:
        return placed.filter(left >= lengths[0]).select(*kept, "at", runs[0].alias("shingle"))
    return placed.select(*kept, "at", F.explode(F.array(*runs)).alias("shingle")).filter("shingle IS NOT NULL")


def _gathered(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """df, written by few tasks. Its last stage reads a table or sums by key, so none of its partitions is a skewed join's."""
    return written(df.coalesce(max(TASKS, df.sparkSession.sparkContext.defaultParallelism)), name, lasting=lasting)


def _sized(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def prefixes(texts: DataFrame, wanted: DataFrame, lengths: list[int], scratch: list[DataFrame]) -> DataFrame:
    """(shingle, lead, size, h1, h2), a written table: each window's first shingle in the global order (frequency, hash).
    One that no document has makes the window impossible."""
    own = F.least("size", F.lit(SHINGLE))
    of = wanted.select("h1", "h2", "size", "tokens").distinct()
    vocabulary = None
    for n in lengths:  # at most SHINGLE
        each = _shingles_of(of.filter(own == n), "tokens", [n], "h1", "h2", "size")
        vocabulary = each if vocabulary is None else vocabulary.unionByName(each)
    vocabulary = _gathered(vocabulary, "vocabulary")
    known = _gathered(vocabulary.select("shingle").distinct(), "shingles")
    rows, every = known.count(), _shingles_of(texts, "w", lengths).select("shingle")
    count = F.count(F.lit(1)).alias("df")
    # a vocabulary that can't be broadcast meets sums, not rows
    frequency = every.join(F.broadcast(known), "shingle").groupBy("shingle").agg(count) if rows <= BROADCAST_ROWS else every.groupBy("shingle").agg(count).join(known, "shingle")
    frequency = _gathered(frequency, "frequencies")
    first = vocabulary.join(_sized(frequency, rows), "shingle", "left").groupBy("h1", "h2", "size").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "at")).alias("p"))
    scratch += [vocabulary, known, frequency]
    return _gathered(first.filter("p.df > 0").select(F.col("p.shingle").alias("shingle"), F.col("p.at").alias("lead"), "size", "h1", "h2"), "prefixes")


def occurrences(texts: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """texts (k1, k2, w), w being words -> (k1, k2, item_id, start, size), a written table: every occurrence of an item's
    window in a text. Equal texts are one."""
    h1, h2 = _window_hash(F.col("tokens"))
    wanted = _gathered(windows(benchmark, window).withColumns({"h1": h1, "h2": h2}), "windows")
    lengths = sorted(r["n"] for r in wanted.select(F.least("size", F.lit(SHINGLE)).alias("n")).distinct().collect())  # at most SHINGLE rows
    scratch = [wanted]
    if not lengths:
        item = benchmark.schema["item_id"].dataType
        return texts.filter(F.lit(False)).select("k1", "k2", F.lit(None).cast(item).alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("size"))
    first = prefixes(texts, wanted, lengths, scratch)
    scratch.append(first)
    begin = (F.col("at") - F.col("lead")).alias("start")
    found = F.slice("w", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("size"))
    if first.count() <= BROADCAST_ROWS:
        met = _shingles_of(texts, "w", lengths, "k1", "k2", "w").join(F.broadcast(first), "shingle").select("k1", "k2", "w", begin, "size", "h1", "h2")
    else:
        every = _shingles_of(texts.withColumn("n", F.size("w")), "w", lengths, "k1", "k2", "n")
        may = every.join(first, "shingle").select("k1", "k2", "n", begin, "size", "h1", "h2").filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n")))
        may = may.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "size", "h1", "h2")).alias("places"))
        may = _gathered(may.select(F.struct("k1", "k2").alias("id"), "places"), "places")  # at most a text's words have windows
        scratch.append(may)
        met = by_ids(texts.withColumn("key", F.struct("k1", "k2")), "key", may, "inner", KEYS).select("k1", "k2", "w", F.inline("places"))
    fits = (F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.size("w"))
    alike = [F.when(fits, a).otherwise(F.lit(None)) == F.col(b) for a, b in zip(_window_hash(found), ("h1", "h2"), strict=True)]
    hits = met.filter(fits & alike[0] & alike[1]).select("k1", "k2", "start", "size", "h1", "h2", found.alias("tokens"))
    same = wanted.drop("size").withColumnRenamed("tokens", "words")
    named = _gathered(hits.join(same, ["h1", "h2"]).filter("tokens = words").select("k1", "k2", "item_id", "start", "size").distinct(), "occurrences")
    discard(*scratch)
    return named


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of docs."""
    keyed = docs.select(key, *text_key(F.col("text")), words(F.col("text")).alias("w"))
    with scratch():
        hits = occurrences(keyed.drop(key), benchmark, window)
        covered = hits.select("k1", "k2", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("word")).distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_hit"))
        # distinct items of a document: at most as many as its words have windows
        items = hits.groupBy("k1", "k2").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
        listed = F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256")
        both = covered.join(items, ["k1", "k2"]).select(F.struct("k1", "k2").alias("id"), "n_hit", F.size("items").alias("n_items"), listed)
        judged = _gathered(both, "judged", lasting=True)
    counted = keyed.select(key, F.struct("k1", "k2").alias("_text"), F.size("w").cast("bigint").alias("n_words"))
    joined = by_ids(counted, "_text", judged, "left", KEYS)
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return joined.select(
        key, "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
