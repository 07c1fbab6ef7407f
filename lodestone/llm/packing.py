"""Best-fit decreasing packing of documents into sequences.

Best-fit decreasing depends on the lengths alone, and there are at most ``capacity`` different lengths. So the
exact global packing is planned from a histogram of lengths: for each length in decreasing order, a segment tree
over remaining capacities finds the tightest open bin in a logarithm of steps, and a run of equal documents into a
run of equal bins is one step instead of many. The plan is a list of runs, (length, ranks from .. to) -> (first
bin, documents a bin, offset); its size depends on capacity and not on the number of documents. Workers then look
up each piece by its length and its rank among the pieces of that length. Ranks are counted where pieces are
written, by part and length, so no task ranks a whole length, however common.

Defined results: null text is empty and is a piece of the end token alone; a document of more than ``capacity``
tokens is cut into pieces of ``capacity``, of which the first takes the rest; repeated rows are packed as rows of
their own; an empty table gives no pieces; extra columns are never read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, written
from .tokens import REMEMBERED, encoder

CAPACITY = 2048


class OpenBins:
    """A segment tree over remaining capacities 0 .. capacity; a leaf holds runs of open bins [first bin, count]."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, remaining: int, first: int, count: int) -> None:
        if count and remaining:
            self.runs.setdefault(remaining, []).append((first, count))
            at = self.leaves + remaining
            while at and not self.any[at]:
                self.any[at] = 1
                at >>= 1

    def take(self, remaining: int) -> tuple[int, int]:
        run = self.runs[remaining].pop()
        if not self.runs[remaining]:
            del self.runs[remaining]
            at = self.leaves + remaining
            self.any[at] = 0
            while at > 1:
                at >>= 1
                self.any[at] = self.any[2 * at] | self.any[2 * at + 1]
        return run

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least length."""
        at = self.leaves + length
        if self.any[at]:
            return length
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, rank from, first bin, documents a bin, offset), sorted by length and rank."""
    bins, opened, rows = OpenBins(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            else:
                first, count = bins.take(room)
            each = room // length  # the bin just served stays the tightest until it is full
            full = min(count, left // each)
            if full:
                rows.append((length, rank, first, each, capacity - room))
                bins.add(room - each * length, first, full)
                rank, left, first, count = rank + full * each, left - full * each, first + full, count - full
            if left and count:
                rows.append((length, rank, first, left, capacity - room))
                bins.add(room - left * length, first, 1)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            if count:
                bins.add(room, first, count)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer: str, split: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, [ids binary], part, part_rank)"""
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = np.array([end_id], "<u4").tobytes()
    fields = ["piece", "start", "length", "ids_crc32", "part", "part_rank"]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, ranks = encoder(tokenizer, split, remembered).encode, TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in stream:
            rows, of, ids = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = (encode(text) if text else b"") + last
                total = len(raw) // 4
                head = total % capacity or min(total, capacity)
                for piece, end in enumerate(range(head, total + 1, capacity)):
                    start = max(0, end - capacity) if piece else 0
                    own = raw[4 * start : 4 * end]
                    rows.append((piece, start, end - start, zlib.crc32(own), part, ranks[end - start]))
                    ranks[end - start] += 1
                    of.append(i)
                    if with_ids:
                        ids.append(own)
            made = np.array(rows, np.int64).reshape(-1, len(fields))
            doc = batch.column("doc_id").take(pa.array(of, pa.int64()))
            columns = [doc, made[:, 0].astype(np.int32), *(made[:, j] for j in range(1, len(fields)))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns[1:]), doc, *([pa.array(ids, pa.binary())] if with_ids else [])], names=[*fields, "doc_id", *(["ids"] if with_ids else [])])

    schema = "piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, part_rank bigint, doc_id " + kind + (", ids binary" if with_ids else "")
    return map_arrow(docs.select("doc_id", "text"), batches, schema)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut as pieces() wrote it, plus sequence_id and offset. cut is read twice and must be a written table."""
    per_part = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    spark = cut.sparkSession
    rows = plan(histogram, capacity)
    placed = spark.sparkContext.broadcast(rows)  # a function of capacity, see plan()
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("before") + F.col("part_rank")).drop("part", "part_rank", "before")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = placed.value
        first = np.searchsorted(steps[:, 0], np.arange(capacity + 2))  # where each length's steps begin
        for batch in stream:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.empty(len(length), np.int64)
            for own in np.unique(length):
                mine = length == own
                lo, hi = first[own], first[own + 1]
                at[mine] = lo + np.searchsorted(steps[lo:hi, 1], rank[mine], side="right") - 1
            step = steps[at]
            nth = rank - step[:, 1]
            kept = [c for c in batch.schema.names if c != "rank"]
            made = [pa.array(step[:, 2] + nth // step[:, 3]), pa.array(step[:, 4] + nth % step[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return map_arrow(ranked, batches, f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, split: str = "byte", end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, [ids], sequence_id, offset), a row a piece."""
    placed = place(written(pieces(docs, tokenizer, split, end_id, capacity, with_ids, remembered), "pieces"), capacity)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset")
