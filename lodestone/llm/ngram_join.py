"""N-gram Jaccard join with several global token orders.

Documents are sets of word n-grams; two link when their Jaccard similarity is at least P / Q. The join is exact.

* Documents with equal sets are one class, numbered when its row is written; from here on, classes are joined. A
  class is represented by its row of least doc_id, which a key of 128 bits over id and text finds again.
* A set of n tokens must share at least ceil(n P / Q) with any partner, so under any global token order the two
  prefixes of n - ceil(n P / Q) + 1 tokens have a token in common. Three orders are used. The first is rarest first
  (by frequency estimates, which need only be the same for all documents) and is joined on; position and length
  bounds apply in the join. The other two are hash orders; a candidate pair must share prefix tokens in each, and
  only pairs that pass all three are verified on the full sets.
* A token that more than CROWD classes have in their prefix is not expanded into pairs. The crowd is compared with
  its centre c, the tokens that at least half of it have. With D(x) the symmetric difference of x and c,
  |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|, and x and y link exactly if W(x) + W(y) <= 2 (P + Q) |D(x) & D(y)|,
  where W(x) = (P + Q) |D(x)| - (Q - P) |x|. Let b have the least W. Every x with W(x) + W(b) <= 0 links to b: a
  star replaces their pairs. A remaining x can only link to a y with which it shares at least
  (W(x) + W(y)) / (2 (P + Q)) > 0 tokens of difference, so prefixes of the differences, rarest in the crowd first,
  are joined in turn. A token of difference is one of at most half the crowd, so that crowds in crowds shrink.

Frequency estimates: tokens that occur in SHOWN or more documents of a run of RUN tokens are summed over all runs,
and the TABLE most frequent of them make the first order; all other tokens count as rare. Estimates bear on
speed, never on results. Exact copies, crowds and stars cost rows in proportion to their documents. Candidates of one
class are verified in runs of about GUESTS texts, each with a copy of its own text, so a class that meets very many is
many tasks' work.

Defined results: null text, empty text and text without words has the empty set, size 0, and is linked with
nothing; a document of fewer than n words has one token, its whole sequence; repeated rows link as copies; a row
with a null doc_id keeps its size, has a null component and links with nothing; rows that share a doc_id are in one
component, as if linked, and each keeps the size of its own text; an empty table gives an empty result; extra columns
are never read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_ids, discard, map_arrow, scratch, utf8_views, written
from .components import components
from .textkernel import LOWER, mix, ngrams, spans, word_hashes

U = np.uint64
SHOWN, TABLE, RUN = 3, 1 << 19, 1 << 22
#: Classes with a prefix token in common beyond which they are compared with a centre instead of in pairs.
CROWD = 128
#: Centres (some kilobytes each) up to which they are broadcast.
CENTRES = 4_000
#: Candidates of a class that are verified in one run.
GUESTS = 512
#: Row keys (some 100 bytes each in Spark's table) up to which they are broadcast.
KEYS = 300_000
#: Parts of the prefix tokens that are counted one after another: only one part's shuffle is on disk at a time.
PARTS = 4
#: Prefix tokens up to which the filters keep 16 bits of each, else 32: few strangers meet by chance among so few.
NARROW = 128
_SEEDS = (U(0x243F6A8885A308D3), U(0x13198A2E03707344), U(0xA4093822299F31D0))


def tokens(text: np.ndarray | None, n: int) -> np.ndarray:
    """The set of a text, as sorted hashes."""
    if text is None or not len(text):
        return np.empty(0, np.uint64)
    lowered = LOWER[text]
    starts, ends = spans(lowered)
    if not len(starts):
        return np.empty(0, np.uint64)
    return np.unique(ngrams(word_hashes(lowered, starts, ends), min(n, len(starts))))


def prefix_size(n: int, p: int, q: int) -> int:
    return n - -(-n * p // q) + 1 if n else 0


def by_order(found: np.ndarray, order: int, often: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The tokens in a global order: the first is rarest first, then by hash; the others are by hash alone."""
    key = mix(found ^ _SEEDS[order])
    if order == 0 and len(often):
        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
        seen = np.where(often[at] == found, np.minimum(count[at], 0xFFFF), 0).astype(np.uint64)
        key = (seen << U(48)) | (key >> U(16))
    return found[np.argsort(key, kind="stable")]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k1, k2): rows of equal doc_id and text have equal keys."""
    parts = [x for c in ("doc_id", "text") for x in (F.col(c), F.col(c).isNull())]
    keys = [F.xxhash64(F.lit(seed), *parts).alias(f"k{seed}") for seed in (1, 2)]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").select("*", *keys)


def survey(docs: DataFrame, n: int) -> DataFrame:
    """keyed docs -> a row (doc_id, k1, k2, size, digest) for each, and rows (token, seen) of what is frequent in a run of them."""
    names = ["is_doc", "doc_id", "k1", "k2", "size", "digest", "token", "seen"]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            every = np.concatenate([*held, np.empty(0, np.uint64)])
            held.clear()
            every.sort()
            # a token of k occurrences equals the one SHOWN - 1 places on k - SHOWN + 1 times
            again = every[SHOWN - 1 :][every[SHOWN - 1 :] == every[: len(every) - SHOWN + 1]] if len(every) >= SHOWN else every[:0]
            token, seen = np.unique(again, return_counts=True)
            none = [pa.nulls(len(token), t) for t in (*[pa.int64()] * 4, pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([False] * len(token), pa.bool_()), *none, pa.array(_signed(token)), pa.array(seen.astype(np.int64) + SHOWN - 1)], names=names)

        for batch in stream:
            sets = [tokens(x, n) for x in utf8_views(batch.column("text"))]
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            k = len(sets)
            columns = [pa.array([True] * k, pa.bool_()), *(batch.column(c) for c in names[1:4]), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            held += sets
            if sum(map(len, held)) > RUN:
                yield told()
        yield told()

    return map_arrow(docs, batches, "is_doc boolean, doc_id bigint, k1 bigint, k2 bigint, size bigint, digest binary, token bigint, seen bigint")


def frequent(surveyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The TABLE most frequent tokens, sorted, and their estimates."""
    summed = surveyed.filter(~F.col("is_doc")).groupBy("token").agg(F.sum("seen").alias("n"))
    top = summed.orderBy(F.desc("n"), "token").limit(TABLE).toPandas()
    token, n = top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(token)
    return token[order], n[order]


def narrowed(tokens: np.ndarray) -> bytes:
    """The upper 16 bits of each of a few tokens, 32 of many, after a byte that says how many bytes each has. Equal
    tokens stay equal, and that is all a filter needs."""
    wide = len(tokens) > NARROW
    return bytes([4 if wide else 2]) + ((tokens >> U(32)).astype(np.uint32) if wide else (tokens >> U(48)).astype(np.uint16)).tobytes()


def share(a: bytes, b: bytes) -> bool:
    """Whether two narrowed sets may have a token in common: never False if they have."""
    x, y = (np.frombuffer(c, np.uint16 if c[0] == 2 else np.uint32, offset=1) for c in (a, b))
    if x.dtype != y.dtype:
        x, y = (c if c.itemsize == 2 else (c >> np.uint32(16)).astype(np.uint16) for c in (x, y))
    return len(np.intersect1d(x, y)) > 0


def prefixes(docs: DataFrame, n: int, p: int, q: int, often: np.ndarray, count: np.ndarray) -> DataFrame:
    """keyed docs -> (doc_id, k1, k2, digest, size, first array<bigint>, second binary, third binary) of those with words.

    The second and third are narrowed."""
    shared = docs.sparkSession.sparkContext.broadcast((often, count))  # at most TABLE tokens

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = shared.value
        for batch in stream:
            named, digests, sizes, cut = [], [], [], ([], [], [])
            for doc, view in enumerate(utf8_views(batch.column("text"))):
                found = tokens(view, n)
                if not len(found):
                    continue
                named.append(doc)
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sizes.append(len(found))
                for order in range(3):
                    first = by_order(found, order, known, times)[: prefix_size(len(found), p, q)]
                    cut[order].append(narrowed(first) if order else _signed(first))
            at = pa.array(named, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in ("doc_id", "k1", "k2")), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), _lists(cut[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cut[1:])],
                names=["doc_id", "k1", "k2", "digest", "size", "first", "second", "third"],
            )

    return map_arrow(docs.filter("doc_id IS NOT NULL"), batches, "doc_id bigint, k1 bigint, k2 bigint, digest binary, size bigint, first array<bigint>, second binary, third binary")


def classes(prefixed: DataFrame) -> DataFrame:
    """(cid, digest, doc_id, key, size, first, second, third): the row of the least doc_id of each set. Rows are written
    where they are made, and cid numbers them; copies are found by digests and numbers alone, so no prefix is shuffled
    for them unless they are very many."""
    rows = written(prefixed.select(F.monotonically_increasing_id().alias("cid"), "digest", "doc_id", F.struct("k1", "k2").alias("key"), "size", "first", "second", "third"), "classes")
    least = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "key", "cid")).alias("r"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = rows.select("cid", "digest").join(least.select("digest", F.col("r.cid").alias("least")), "digest").filter("cid <> least")
    copies = written(copies.select(F.col("cid").alias("id")), "copies")
    return rows if copies.isEmpty() else by_ids(rows, "cid", copies, "left_anti")


def texts_of(docs: DataFrame, surveyed: DataFrame) -> DataFrame:
    """keyed docs -> (key, text), a row a key: rows that are repeated whole meet in partial aggregates, others aren't moved."""
    texts = docs.select(F.struct("k1", "k2").alias("key"), "text")
    again = written(surveyed.filter("is_doc").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.struct("k1", "k2").alias("id")), "repeated")
    if again.isEmpty():
        return texts
    held = by_ids(texts, "key", again, "left_semi", KEYS).groupBy("key").agg(F.first("text").alias("text"))
    return by_ids(texts, "key", again, "left_anti", KEYS).unionByName(held)


def postings(named: DataFrame, often: np.ndarray, count: np.ndarray, part: int = 0, parts: int = 1) -> DataFrame:
    """(token, cid, size, pos, crowd): prefix tokens of two classes or more, with the number of classes. Of parts that
    have all tokens between them, the one of this number.

    Tokens known to be frequent are counted by partial sums and joined back; the others, of which no run had
    more than a few, are counted in a window."""
    spark = named.sparkSession
    every = named.select("cid", "size", F.posexplode("first").alias("pos", "token")).filter(F.pmod("token", F.lit(parts)) == part)
    hot = spark.createDataFrame([(int(t),) for t, n in zip(_signed(often), count, strict=True) if n > CROWD], "token bigint")
    apart = every.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "token", "left")  # at most TABLE rows
    cold = apart.filter("hot is null").withColumn("crowd", F.count(F.lit(1)).over(Window.partitionBy("token")))
    sums = apart.filter("hot").groupBy("token").agg(F.count(F.lit(1)).alias("crowd"))
    crowded = apart.filter("hot").join(F.broadcast(sums), "token")  # at most TABLE rows
    columns = ["token", "cid", "size", "pos", "crowd"]
    return cold.select(*columns).unionByName(crowded.select(*columns)).filter("crowd > 1")


def pairs(small: DataFrame, p: int, q: int) -> DataFrame:
    """(x, y), x < y, distinct: classes with a prefix token in common within the length and position bounds."""
    a, b = small.alias("a"), small.alias("b")
    close = (q * F.col("a.size") >= p * F.col("b.size")) & (q * F.col("b.size") >= p * F.col("a.size"))
    # from a common token on, no more can be shared than what is left of the shorter rest
    most = 1 + F.least(F.col("a.size") - F.col("a.pos") - 1, F.col("b.size") - F.col("b.pos") - 1)
    enough = (p + q) * most >= p * (F.col("a.size") + F.col("b.size"))
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.cid") < F.col("b.cid")) & close & enough)
    return met.select(F.col("a.cid").alias("x"), F.col("b.cid").alias("y")).distinct()


def filtered(candidates: DataFrame, live: DataFrame) -> DataFrame:
    """Candidates that share prefix tokens under the second and the third order as well."""
    x = live.select(F.col("cid").alias("x"), F.col("second").alias("x2"), F.col("third").alias("x3"))
    y = live.select(F.col("cid").alias("y"), F.col("second").alias("y2"), F.col("third").alias("y3"))
    both = candidates.join(x, "x").join(y, "y")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ends = zip(*(batch.column(c).to_pylist() for c in ("x2", "y2", "x3", "y3")), strict=True)
            mask = pa.array([share(x2, y2) and share(x3, y3) for x2, y2, x3, y3 in ends], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("x", "y")], names=["x", "y"])

    return map_arrow(both, batches, "x bigint, y bigint")


def oriented(candidates: DataFrame) -> DataFrame:
    """Candidates (x, y) as (home, other): home is the end with more candidates, so that few texts are homes."""
    degree = candidates.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    x, y = degree.select(F.col("id").alias("x"), F.col("n").alias("nx")), degree.select(F.col("id").alias("y"), F.col("n").alias("ny"))
    both = candidates.join(x, "x").join(y, "y")
    first = (F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    return both.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("home"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("other"))


def packed(rows: DataFrame) -> DataFrame:
    """rows of longs and a text, which becomes its bytes (zstd) and their number: Spark's shuffles compress texts less."""
    names = [c for c in rows.columns if c != "text"]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in stream:
            texts = list(utf8_views(batch.column("text")))
            columns = [*(batch.column(c) for c in names), pa.array(map(len, texts), pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "length", "packed"])

    return map_arrow(rows.select(*names, "text"), batches, ", ".join(f"{c} bigint" for c in [*names, "length"]) + ", packed binary")


def verified(at_home: DataFrame, named: DataFrame, texts: DataFrame, n: int, p: int, q: int, scratch: list[DataFrame]) -> DataFrame:
    """Candidates (home, other) whose full sets have a similarity of P / Q or more, as (u, v).

    A home's own text comes first in each of its runs of rows, then those of its candidates: every text is shuffled
    once for each run as a home and once for each of its homes. texts: (key, text)."""
    runs_of = at_home.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / GUESTS).alias("runs"))
    key = lambda name, to: named.select(F.col("cid").alias(name), F.col("key").alias(to))
    homes = written(runs_of.join(key("home", "id"), "home"), "homes")
    guests = written(at_home.join(homes.drop("id"), "home").withColumn("run", F.pmod(F.xxhash64("other"), F.col("runs"))).drop("runs").join(key("other", "id"), "other"), "guests")
    scratch += [homes, guests]
    invited = by_ids(texts, "key", guests, "inner", KEYS).select("home", "run", "other", "text")
    invited = packed(invited).select("home", "run", "other", "length", "packed")
    hosts = packed(by_ids(texts, "key", homes, "inner", KEYS).select("home", "runs", "text"))
    hosts = hosts.select("home", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("runs") - 1)).alias("run"), F.lit(None).cast("bigint").alias("other"), "length", "packed")
    runs = hosts.unionByName(invited).repartition("home", "run").sortWithinPartitions("home", "run", F.col("other").asc_nulls_first()).drop("run")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, codec = np.empty(0, np.uint64), pa.Codec("zstd")
        for batch in stream:
            homes, others, kept = batch.column("home"), batch.column("other"), []
            for other, length, held in zip(others.to_pylist(), batch.column("length").to_pylist(), batch.column("packed"), strict=True):
                found = tokens(np.frombuffer(codec.decompress(held.as_buffer(), length), np.uint8), n)
                if other is None:
                    own = found
                shared = 0 if other is None else len(np.intersect1d(own, found, assume_unique=True))
                kept.append(shared > 0 and q * shared >= p * (len(own) + len(found) - shared))
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([homes.filter(mask), others.filter(mask)], names=["u", "v"])

    return map_arrow(runs, batches, "u bigint, v bigint")


def token_sets(texts: DataFrame, n: int) -> DataFrame:
    """(cid, size, tokens array<bigint>) of texts (cid, text)."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            sets = [_signed(tokens(x, n)) for x in utf8_views(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([len(s) for s in sets], pa.int64()), _lists(sets, pa.int64())], names=["cid", "size", "tokens"])

    return map_arrow(texts.select("cid", "text"), batches, "cid bigint, size bigint, tokens array<bigint>")


class CrowdStep(NamedTuple):
    stars: DataFrame  # links (u, v)
    pairs: DataFrame  # candidates (x, y)
    deeper: DataFrame  # members (crowd, cid) of crowds within the crowds
    scratch: list[DataFrame]


def crowd_step(members: DataFrame, sets: DataFrame, p: int, q: int) -> CrowdStep:
    """members (crowd, cid) against the crowds' centres; sets: (cid, size, tokens)."""
    sized = members.groupBy("crowd").agg(F.count(F.lit(1)).alias("m"))
    held = members.join(sets, "cid")
    shares = held.select("crowd", F.explode("tokens").alias("token")).groupBy("crowd", "token").agg(F.count(F.lit(1)).alias("k"))
    # a centre has at most twice as many tokens as a member has on average
    centre = written(shares.join(sized, "crowd").filter("2 * k >= m").groupBy(F.col("crowd").alias("id")).agg(F.collect_list("token").alias("centre")), "centres")
    off = by_ids(held, "crowd", centre, "left", CENTRES).withColumn("centre", F.coalesce("centre", F.array().cast("array<bigint>")))
    d = F.concat(F.array_except("tokens", "centre"), F.array_except("centre", "tokens"))
    off = off.select("crowd", "cid", "size", d.alias("d")).withColumn("w", (p + q) * F.size("d") - (q - p) * F.col("size"))
    off = written(off, "crowds")

    best = written(off.groupBy(F.col("crowd").alias("id")).agg(F.min(F.struct("w", "cid")).alias("b")).select("id", F.col("b.w").alias("bw"), F.col("b.cid").alias("b")), "best")
    judged = by_ids(off, "crowd", best, "inner")
    stars = judged.filter("cid <> b AND w + bw <= 0").select(F.col("cid").alias("u"), F.col("b").alias("v"))
    far = judged.withColumn("far", F.col("w") + F.col("bw") > 0)
    least_far = written(far.filter("far").groupBy(F.col("crowd").alias("id")).agg(F.min("w").alias("fw")), "least-far")
    far = by_ids(far, "crowd", least_far, "inner")  # crowds in which all link to the best are done

    local = written(off.select("crowd", F.explode("d").alias("token")).groupBy("crowd", "token").agg(F.count(F.lit(1)).alias("k")), "shares")
    each = far.select("crowd", "cid", "size", "w", "bw", "fw", "far", F.size("d").alias("nd"), F.explode("d").alias("token")).join(local, ["crowd", "token"])
    each = each.withColumn("pos", F.row_number().over(Window.partitionBy("crowd", "cid").orderBy("k", "token")) - 1).filter("k > 1")
    share = lambda a, b: F.ceil((F.col(a) + F.col(b)) / (2 * (p + q)))
    entries = each.withColumn("long", F.col("far") & (F.col("pos") <= F.col("nd") - share("w", "bw"))).withColumn("short", F.col("pos") <= F.col("nd") - share("w", "fw"))
    entries = written(entries.filter("long OR short").select(F.xxhash64("crowd", "token").alias("crowd"), "cid", "size", "w", "nd", "pos", "far", "long", "short"), "differences")

    counts = entries.groupBy("crowd").agg(F.sum(F.col("long").cast("bigint")).alias("l"), F.sum(F.col("short").cast("bigint")).alias("s"))
    counts = counts.filter("l > 0 AND s > 0 AND l + s > 1").select(F.col("crowd").alias("id"), (F.col("l") * F.col("s") > CROWD * CROWD).alias("deep"))
    counts = written(counts, "inner-crowds")
    told = by_ids(entries, "crowd", counts, "inner")
    deeper = told.filter("deep").select("crowd", "cid").distinct()
    x, y = told.filter("NOT deep AND long").alias("x"), told.filter("NOT deep AND short").alias("y")
    need = F.ceil((F.col("x.w") + F.col("y.w")) / (2 * (p + q)))
    fits = (F.col("x.pos") <= F.col("x.nd") - need) & (F.col("y.pos") <= F.col("y.nd") - need)
    close = (q * F.col("x.size") >= p * F.col("y.size")) & (q * F.col("y.size") >= p * F.col("x.size"))
    met = x.join(y, (F.col("x.crowd") == F.col("y.crowd")) & (F.col("x.cid") != F.col("y.cid")) & fits & close)
    couples = met.select(F.least("x.cid", "y.cid").alias("x"), F.greatest("x.cid", "y.cid").alias("y")).distinct()
    return CrowdStep(stars, couples, deeper, [centre, off, best, least_far, local, entries, counts])


def links(named: DataFrame, texts: DataFrame, often: np.ndarray, count: np.ndarray, n: int, p: int, q: int) -> DataFrame:
    """(u, v): links between classes from which all links' components follow, each of them verified or proven.
    named: classes, a written table, less copies; texts: (key, text)."""
    scratch = [written(postings(named, often, count, part, PARTS), "postings") for part in range(PARTS)]
    posted = reduce(DataFrame.unionByName, scratch)
    couples, stars = [written(pairs(posted.filter(F.col("crowd") <= CROWD), p, q), "pairs")], []
    scratch += couples
    members = posted.filter(F.col("crowd") > CROWD).select(F.col("token").alias("crowd"), "cid")
    while True:
        # crowds of the same classes are one
        marks = members.groupBy("crowd").agg(F.count(F.lit(1)).alias("m"), F.sum((F.xxhash64("cid") % 1_000_000_007).cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("cid")).alias("h"))
        one = marks.groupBy("m", "s", "h").agg(F.min("crowd").alias("crowd")).select("crowd")
        members = written(members.join(one, "crowd", "left_semi"), "members")
        scratch.append(members)
        if members.isEmpty():
            break
        ids = written(members.select("cid").distinct().join(named.select("cid", F.col("key").alias("id")), "cid"), "member-ids")
        step = crowd_step(members, token_sets(by_ids(texts, "key", ids, "inner", KEYS), n), p, q)
        stars.append(written(step.stars, "stars"))
        couples.append(written(step.pairs, "pairs"))
        members = step.deeper
        scratch += [ids, stars[-1], couples[-1], *step.scratch]

    candidates = couples[0]
    for more in couples[1:]:
        candidates = candidates.unionByName(more)
    ends = candidates.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    met = written(ends, "met")
    passed = written(filtered(candidates.distinct(), by_ids(named.select("cid", "second", "third"), "cid", met, "left_semi")), "passed")
    at_home = written(oriented(passed), "at-home")
    checked = verified(at_home, named, texts, n, p, q, scratch)
    for more in stars:
        checked = checked.unionByName(more)
    found = written(checked, "links")
    discard(*scratch, met, passed, at_home)
    return found


def shared_ids(each: DataFrame, named: DataFrame) -> DataFrame:
    """(u, v): classes that have a doc_id in common, each with the least of them. each: (doc_id, digest) with words."""
    several = written(each.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select(F.col("doc_id").alias("id")), "shared-ids")
    of = by_ids(each, "doc_id", several, "left_semi").distinct().join(named.select("digest", "cid"), "digest").select("doc_id", "cid")
    least = of.groupBy("doc_id").agg(F.min("cid").alias("v"))
    return of.join(least, "doc_id").filter("cid <> v").select(F.col("cid").alias("u"), "v")


def jaccard_components(docs: DataFrame, n: int = 3, p: int = 90, q: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs (doc_id, text)."""
    docs = keyed(docs)
    with scratch():
        surveyed = written(survey(docs, n), "survey", lasting=True)
        often, count = frequent(surveyed)
        named = classes(prefixes(docs, n, p, q, often, count))
        every = surveyed.filter("is_doc").select("doc_id", "size", "digest")
        told = every.filter("size > 0 AND doc_id IS NOT NULL")
        found = links(named, texts_of(docs, surveyed), often, count, n, p, q)
        rooted = components(found.unionByName(shared_ids(told.select("doc_id", "digest"), named)))
        linked = rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct())
        least = linked.join(named.select(F.col("cid").alias("node"), "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("component"))
        of = linked.join(least, "root").select(F.col("node").alias("cid"), "component")
        of = named.select("cid", "digest", "doc_id").join(of, "cid", "left").select(F.col("digest").alias("id"), F.coalesce("component", "doc_id").alias("component"))
        roots = written(of, "roots", lasting=True)
    joined = by_ids(every, "digest", roots, "left", 0)  # a row a class: always shuffled
    own = F.when((F.col("size") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"))
