"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of 0 to ORDER bytes with the counts of the bytes that followed.
A byte costs -log2(count / (total + distinct)) in the longest context in which its language has seen it; each
longer known context in between costs the escape -log2(distinct / (total + distinct)) (method C, without
exclusions), and a byte that the language has never seen costs 8 bits after the last escape. Contexts that a
language has not seen cost nothing. Statistics are frozen after training, so the cost of a byte depends on its
ORDER predecessors alone. A model keeps, for each language and depth, sorted tables of its own contexts and of the bytes
that followed them, so its size is linear in what was learned, whatever other languages or bytes there are. The
distinct runs of ORDER + 1 bytes of a stretch of texts are looked up once, and the code lengths of its texts are sums
of these costs.

Training reads the whole texts of a bounded sample of the labelled rows: SAMPLE_DOCS documents a language
expected, chosen by a hash of doc_id. Counts merge by addition over tasks. The trees keep every context of the sample, so a
language with little training text loses none to larger ones.

Defined results: zero bytes count as bytes never seen; null text or text without a letter is `und` with score 0, as is everything if nothing was
learned; repeated rows get equal results; a tie goes to the first language in string order; empty tables give
empty results; extra columns are never read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, utf8_views

ORDER = 3
SAMPLE_DOCS = 1500
UNDETERMINED = "und"
#: Bits a byte above which a text reads like none of the learned languages (uniform bytes cost 8 and more).
FOREIGN_BITS = 6.5
#: Costs (runs of bytes x languages) that are looked up at once.
CHUNK = 1 << 22
SLOTS = 18


def _within(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether and where a sorted table holds each of the keys."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


@dataclass
class Depth:
    """One language's contexts of one length: codes of their bytes, and of them and the byte that followed."""

    contexts: np.ndarray
    escape: np.ndarray  # bits
    runs: np.ndarray
    cost: np.ndarray  # bits


@dataclass
class Model:
    languages: list[str]
    trees: list[list[Depth]]  # by language and depth

    @property
    def size(self) -> int:
        """Bytes."""
        return sum(x.nbytes for tree in self.trees for d in tree for x in (d.contexts, d.escape, d.runs, d.cost))

    def gram_costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each run of ORDER + 1 bytes, by language."""
        costs = np.zeros((len(grams), len(self.languages)))
        for which, tree in enumerate(self.trees):
            left, bits = np.arange(len(grams)), np.zeros(len(grams))
            for depth in range(ORDER, -1, -1):
                own, run = tree[depth], grams[left] & ((1 << 8 * (depth + 1)) - 1)
                known, at = _within(own.contexts, run >> 8)
                seen, to = _within(own.runs, run)
                # a run with padding has the code of another one, but a context with padding is never known
                seen &= known
                bits[left[seen]] += own.cost[to[seen]]
                escaped = known & ~seen
                bits[left[escaped]] += own.escape[at[escaped]]
                left = left[~seen]
            bits[left] += 8
            costs[:, which] = bits
        return costs

    def code_lengths_of(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits of each text, none of them empty, under every language."""
        total = np.zeros((len(texts), len(self.languages)))
        room = max(1, CHUNK // max(1, len(self.languages)))
        held: list[tuple[int, np.ndarray]] = []

        def add() -> None:
            grams = np.concatenate([x for _, x in held])
            known = np.unique(grams)
            costs = self.gram_costs(known)[_places(known, grams)]
            starts = np.cumsum([0, *(len(x) for _, x in held[:-1])])
            np.add.at(total, [i for i, _ in held], np.add.reduceat(costs, starts, axis=0))
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            for first in range(0, len(text), room):
                piece = text[max(first - ORDER, 0) : first + room]
                held.append((i, _grams(piece)[min(first, ORDER) :]))
                size += len(held[-1][1])
                if size >= room:
                    add()
                    size = 0
        if held:
            add()
        return total

    def code_lengths(self, text: np.ndarray) -> np.ndarray:
        return self.code_lengths_of([text])[0] if len(text) else np.zeros(len(self.languages))


def _places(known: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Places of grams in known, which holds them all: by a table of hashes, and by search where one was taken."""
    of = lambda x: (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS)
    slots = np.zeros(1 << SLOTS, np.int32)
    slots[of(known)] = np.arange(len(known), dtype=np.int32)
    at = slots[of(grams)]
    missed = np.flatnonzero(known[at] != grams)
    at[missed] = np.searchsorted(known, grams[missed])
    return at


def _grams(text: np.ndarray) -> np.ndarray:
    """Codes of the runs of ORDER + 1 bytes that end at each byte, padded with zeros before the text."""
    padded = np.zeros(len(text) + ORDER, np.uint32)
    padded[ORDER:] = text
    code = np.zeros(len(text), np.uint32)
    for j in range(ORDER + 1):
        code = code * np.uint32(256) + padded[j : j + len(text)]
    return code


def has_letter(text: np.ndarray) -> bool:
    folded = text | 0x20
    if ((folded >= 0x61) & (folded <= 0x7A)).any():
        return True
    return any(c.isalpha() for c in text.tobytes().decode("utf-8", "ignore"))


def sampled(labelled: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """(text, lang) of per_language rows a language, expected; all of them where there are fewer."""
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not sizes:
        return known.select("text", "lang")
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    drawn = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1)) < share[F.col("lang")] * float(1 << 30)
    return known.filter(drawn | F.col("doc_id").isNull()).select("text", "lang")


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each run of ORDER + 1 bytes, padded with zeros before the text, occurs."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[np.ndarray]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, codes in parts.items():
                gram, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
            parts.clear()

        for batch in stream:
            for lang, text in zip(batch.column("lang").to_pylist(), utf8_views(batch.column("text")), strict=True):
                parts.setdefault(lang, []).append(_grams(text))
                held += len(text)
                if held > 1 << 24:
                    yield from flush()
                    held = 0
        yield from flush()

    counted = map_arrow(labelled.select("lang", "text"), batches, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, per_language: int = SAMPLE_DOCS) -> Model:
    """labelled: (doc_id, text, lang). What comes to the driver is bounded by the sample and the trees' order."""
    counts = gram_counts(sampled(labelled, per_language)).toArrow()
    return compile_model(counts.column("lang").to_pylist(), counts.column("gram").to_numpy(), counts.column("n").to_numpy())


def compile_model(langs: list[str], grams: np.ndarray, counts: np.ndarray) -> Model:
    languages = sorted(set(langs))
    learned = (grams & 255) > 0  # padding is byte 0, so zero bytes of texts are not learned
    which = np.searchsorted(languages, langs) if languages else np.empty(0, np.int64)
    trees = []
    for i in range(len(languages)):
        own = learned & (which == i)
        trees.append([_depth(grams[own], counts[own], depth) for depth in range(ORDER + 1)])
    return Model(languages, trees)


def _depth(grams: np.ndarray, counts: np.ndarray, depth: int) -> Depth:
    inside = np.ones(len(grams), bool)
    for j in range(1, depth + 1):  # contexts with padding aren't contexts
        inside &= (grams >> 8 * j & 255) > 0
    runs, at = np.unique(grams[inside] & ((1 << 8 * (depth + 1)) - 1), return_inverse=True)
    n = np.bincount(at, counts[inside], len(runs))
    contexts, of, distinct = np.unique(runs >> 8, return_inverse=True, return_counts=True)
    total = np.bincount(of, n, len(contexts))
    escape = -np.log2(distinct / (total + distinct))
    cost = -np.log2(n / (total + distinct)[of])
    return Depth(contexts.astype(np.uint32), escape.astype(np.float32), runs.astype(np.uint32), cost.astype(np.float32))


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred, score (the posterior under equal priors) and bits_per_byte."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    langs = model.languages

    def judge(texts: list[np.ndarray | None], m: Model) -> list[tuple[str, float, float | None]]:
        rows: list[tuple[str, float, float | None]] = [(UNDETERMINED, 0.0, None)] * len(texts)
        told = [i for i, text in enumerate(texts) if langs and text is not None and has_letter(text)]
        for i, bits in zip(told, m.code_lengths_of([texts[i] for i in told]), strict=True):
            best = int(bits.argmin())
            rows[i] = langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()), float(bits[best] / len(texts[i]))
        return rows

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in stream:
            rows = judge(list(utf8_views(batch.column("text"))), m)
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, "lang_pred", "score", "bits_per_byte"])

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    kept = list(dict.fromkeys([*keep, "text"]))
    return map_arrow(docs.select(*kept), batches, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "lang_pred string, score double, bits_per_byte double"]))


def accepted():
    """Whether an identified document is text in one of the learned languages."""
    return (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= 0.5) & (F.col("bits_per_byte") <= FOREIGN_BITS)


def remainder(doc_id, by: int):
    """crc32 of doc_id as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % by


def held_out(doc_id):
    return remainder(doc_id, 5) == 0
