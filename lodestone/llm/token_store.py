"""Token ids in wavelet matrices, one compressed file a shard.

A shard holds the ids of consecutive documents in one matrix. Its alphabet is what occurs in it, renumbered densely;
plane l holds bit l (from the top) of every symbol, after a stable partition by all bits above, zeros first. With the
counts of ones before every BLOCK bits, access, counting of an id in a range, and finding its j-th occurrence take one
rank or select a plane without decoding the rest.

File: MAGIC, the length of a JSON header as 8 bytes, the header, then the sections it lists, each compressed by
Zstandard: ``docs`` (int64 document ids, null as given by ``nulls``), ``ends`` (int64 token counts up to and with
each document), ``symbols`` (uint32 ids of the alphabet), ``occurs`` (uint32 occurrences of each), and of each plane its
``ranks`` (uint32 counts) and its bits, CHUNK of them a section. Sections are read when they are asked for: counting in
the whole shard reads no planes, an access one chunk of each.

Documents are range-partitioned and sorted by doc_id (and row number, so that a repeated id is many tasks' work); a task writes its shards of about SHARD_TOKENS tokens under
names of their own attempt, and a manifest table lists the files of the attempts that counted, so that lost
executors and repeated tasks leave no wrong data. Files are reached by pyarrow's file systems through the URI of
the shared folder.

Defined results: null text is empty and holds the end id alone; rows of a repeated doc_id stay separate rows; null
doc_ids come first; an empty table gives no files and no rows; extra columns are never read."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, map_arrow, written
from .files import open_seekable, open_write
from .tokens import encoder

MAGIC = b"WAVELET2"
SHARD_TOKENS = 1 << 22
#: Bits between two rank counts, and of a plane in a section, a multiple of them.
BLOCK, CHUNK = 512, 1 << 18


def ranks(packed: np.ndarray) -> np.ndarray:
    """Ones before each block of packed bits, and in all."""
    padded = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
    padded[: len(packed)] = packed
    per_block = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32)


class Plane:
    """A bit vector with rank and select. before: ones before each block; chunk(c): the packed bits from c * CHUNK on."""

    def __init__(self, n: int, ones: int, before: np.ndarray, chunk: Callable[[int], np.ndarray]):
        self.n, self.ones, self.zeros, self.before, self.chunk = n, ones, n - ones, before, chunk

    def bits(self) -> np.ndarray:
        """All of them, as booleans."""
        packed = [self.chunk(c) for c in range(-(-self.n // CHUNK))]
        return np.unpackbits(np.concatenate(packed), count=self.n).view(bool) if packed else np.empty(0, bool)

    def _block(self, block: int) -> np.ndarray:
        at = block * BLOCK % CHUNK >> 3
        return self.chunk(block * BLOCK // CHUNK)[at : at + BLOCK // 8]

    def bit(self, i: int) -> int:
        return int(self.chunk(i // CHUNK)[i % CHUNK >> 3] >> (7 - (i & 7))) & 1

    def rank1(self, i: int) -> int:
        """Ones among the first i bits."""
        count, rest = int(self.before[i // BLOCK]), i % BLOCK
        if not rest:
            return count
        packed = self._block(i // BLOCK)
        count += int(np.bitwise_count(packed[: rest >> 3]).sum())
        return count + (int(packed[rest >> 3] >> (8 - (rest & 7))).bit_count() if rest & 7 else 0)

    def rank(self, bit: int, i: int) -> int:
        return self.rank1(i) if bit else i - self.rank1(i)

    def select(self, bit: int, j: int) -> int:
        """The place of the j-th (from 0) such bit."""
        ones = self.before.astype(np.int64)
        starts = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(starts, j, side="right")) - 1
        bits = np.unpackbits(self._block(block))[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[j - int(starts[block])])


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, planes: list[Plane], n: int):
        self.symbols, self.planes, self.n = symbols, planes, n

    @staticmethod
    def width(symbols: int) -> int:
        return max(1, (symbols - 1).bit_length())

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) + 1 if len(ids) else 0
        seen = np.zeros(top, bool)
        seen[ids] = True
        symbols = np.flatnonzero(seen).astype(np.uint32)
        kind = np.uint16 if len(symbols) <= 1 << 16 else np.uint32
        dense = np.zeros(top, kind)
        dense[symbols] = np.arange(len(symbols))
        now, width, planes = dense[ids], cls.width(len(symbols)), []
        for level in range(width):
            ones = (now & kind(1 << (width - 1 - level))) != 0
            up, down = np.flatnonzero(ones), np.flatnonzero(~ones)
            packed = np.packbits(ones)
            planes.append(Plane(len(now), len(up), ranks(packed), lambda c, packed=packed: packed[c * (CHUNK // 8) : (c + 1) * (CHUNK // 8)]))
            parted = np.empty_like(now)
            now.take(down, out=parted[: len(down)], mode="clip")  # clip: without a buffer for out
            now.take(up, out=parted[len(down) :], mode="clip")
            now = parted
        return cls(symbols, planes, len(ids))

    def decode(self) -> np.ndarray:
        """All ids in order: the partitions undone from the last plane to the first."""
        width = len(self.planes)
        kind = np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in reversed(range(width)):
            plane = self.planes[level]
            ones = plane.bits()
            back = np.empty_like(now)
            back[np.flatnonzero(~ones)] = now[: plane.zeros]
            back[np.flatnonzero(ones)] = now[plane.zeros :] | kind(1 << (width - 1 - level))
            now = back
        return self.symbols[now]

    def access(self, i: int) -> int:
        """The id at place i."""
        code = 0
        for plane in self.planes:
            bit = plane.bit(i)
            code = code << 1 | bit
            i = plane.zeros + plane.rank1(i) if bit else plane.rank(0, i)
        return int(self.symbols[code])

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.symbols, token))
        return at if at < len(self.symbols) and self.symbols[at] == token else None

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in [start, end)."""
        code, lo, hi = self._code(token), start, self.n if end is None else end
        if code is None:
            return 0
        for level, plane in enumerate(self.planes):
            bit = code >> (len(self.planes) - 1 - level) & 1
            lo, hi = plane.rank(bit, lo) + bit * plane.zeros, plane.rank(bit, hi) + bit * plane.zeros
        return hi - lo

    def places(self, token: int) -> np.ndarray:
        """All places of an id, in order: its run after the last plane, led back up through all of them."""
        code = self._code(token)
        if code is None:
            return np.empty(0, np.int64)
        bits = [code >> (len(self.planes) - 1 - level) & 1 for level in range(len(self.planes))]
        lo, hi = 0, self.n
        for bit, plane in zip(bits, self.planes, strict=True):
            lo, hi = plane.rank(bit, lo) + bit * plane.zeros, plane.rank(bit, hi) + bit * plane.zeros
        at = np.arange(lo, hi)
        for bit, plane in zip(reversed(bits), reversed(self.planes), strict=True):
            at = np.flatnonzero(plane.bits() == bool(bit))[at - bit * plane.zeros]
        return at

    def locate(self, token: int, j: int) -> int | None:
        """The place of the j-th occurrence, from 0; None if there are fewer."""
        code = self._code(token)
        if code is None or not 0 <= j < self.count(token):
            return None
        bits = [code >> (len(self.planes) - 1 - level) & 1 for level in range(len(self.planes))]
        at = 0
        for bit, plane in zip(bits, self.planes, strict=True):
            at = plane.rank(bit, at) + bit * plane.zeros
        at += j
        for bit, plane in zip(reversed(bits), reversed(self.planes), strict=True):
            at = plane.select(bit, at - bit * plane.zeros)
        return at


class Shard:
    """A shard's file, of which sections are read when asked for."""

    def __init__(self, source):
        """source: a file with seek() and read()."""
        self.source = source
        if self._raw(0, 8) != MAGIC:
            raise ValueError("not a wavelet shard")
        size = int.from_bytes(self._raw(8, 8), "little")
        self.header = json.loads(self._raw(16, size))
        self.body = self.bytes_read = 16 + size

    def _raw(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _section(self, where: list[int]) -> bytes:
        """where: offset, packed size, size."""
        import zstandard

        at, packed, size = where
        self.bytes_read += packed
        return zstandard.ZstdDecompressor().decompress(self._raw(self.body + at, packed), max_output_size=size) if size else b""

    @cached_property
    def docs(self) -> list[int | None]:
        found: list[int | None] = np.frombuffer(self._section(self.header["docs"]), np.int64).tolist()
        for i in self.header["nulls"]:
            found[i] = None
        return found

    @cached_property
    def ends(self) -> np.ndarray:
        return np.frombuffer(self._section(self.header["ends"]), np.int64)

    @cached_property
    def occurs(self) -> np.ndarray:
        """Occurrences of each symbol of the matrix."""
        return np.frombuffer(self._section(self.header["occurs"]), np.uint32)

    @cached_property
    def matrix(self) -> WaveletMatrix:
        n = self.header["tokens"]
        return WaveletMatrix(np.frombuffer(self._section(self.header["symbols"]), np.uint32), [self._plane(n, *p) for p in self.header["planes"]], n)

    def _plane(self, n: int, ones: int, before: list[int], chunks: list[list[int]]) -> Plane:
        shard = self

        class Stored(Plane):
            @cached_property
            def before(self) -> np.ndarray:
                return np.frombuffer(shard._section(before), np.uint32)

        chunk = lru_cache(2)(lambda c: np.frombuffer(self._section(chunks[c]), np.uint8))
        plane = Stored.__new__(Stored)
        plane.n, plane.ones, plane.zeros, plane.chunk = n, ones, n - ones, chunk
        return plane

    def decode(self) -> np.ndarray:
        return self.matrix.decode()

    def access(self, i: int) -> int:
        return self.matrix.access(i)

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        if start == 0 and end in (None, self.header["tokens"]):
            code = self.matrix._code(token)
            return 0 if code is None else int(self.occurs[code])
        return self.matrix.count(token, start, end)

    def locate(self, token: int, j: int) -> int | None:
        return self.matrix.locate(token, j)

    def places(self, token: int) -> np.ndarray:
        return self.matrix.places(token)


def dump(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard's file."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=1)
    packed: list[bytes] = []
    at = 0

    def section(raw) -> list[int]:
        nonlocal at
        packed.append(packer.compress(raw))
        at += len(packed[-1])
        return [at - len(packed[-1]), len(packed[-1]), len(raw)]

    docs = np.array([0 if d is None else d for d in doc_ids], np.int64)
    matrix = WaveletMatrix.build(ids)
    occurs = np.bincount(ids)[matrix.symbols].astype(np.uint32)
    header = {
        "nulls": [i for i, d in enumerate(doc_ids) if d is None], "docs": section(docs.tobytes()), "ends": section(ends.astype(np.int64).tobytes()),
        "tokens": matrix.n, "symbols": section(matrix.symbols.tobytes()), "occurs": section(occurs.tobytes()),
        "planes": [[p.ones, section(p.before.tobytes()), [section(p.chunk(c).tobytes()) for c in range(-(-p.n // CHUNK))]] for p in matrix.planes],
    }
    head = json.dumps(header).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *packed])


def write(docs: DataFrame, tokenizer: str, split: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards; the manifest (part, shard, path, n_docs, n_tokens), a written table."""
    folder = fresh_path(docs.sparkSession, "tokens")
    last = np.array([end_id], "<u4").tobytes()
    numbered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.monotonically_increasing_id().alias("_row"))
    ordered = numbered.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row").drop("_row")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, attempt = encoder(tokenizer, split).encode, TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        ids: list[bytes] = []
        owners: list[int | None] = []
        ends: list[int] = []
        shard = 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/part-{part:06d}-{shard:06d}-{attempt}.wavelet"
            with open_write(path) as out:
                out.write(dump(owners, np.array(ends), np.frombuffer(b"".join(ids), "<u4")))
            columns = [[part], [shard], [path], [len(owners)], [ends[-1]]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "shard", "path", "n_docs", "n_tokens"])

        for batch in stream:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append((encode(text) if text else b"") + last)
                owners.append(doc)
                ends.append((ends[-1] if ends else 0) + len(ids[-1]) // 4)
                if ends[-1] >= shard_tokens:
                    yield flush()
                    ids, owners, ends, shard = [], [], [], shard + 1
        if owners:
            yield flush()

    schema = "part bigint, shard bigint, path string, n_docs bigint, n_tokens bigint"
    return written(map_arrow(ordered, batches, schema), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """manifest plus base: tokens in all earlier shards. Sums over parts first, so a part is one row in one window."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_parts"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(parts, "part").withColumn("base", F.col("_parts") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).drop("_parts")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with open_seekable(path) as source:
                    shard = Shard(source)
                    docs, ends, ids = shard.docs, shard.ends, memoryview(shard.decode().astype("<u4", copy=False)).cast("B")
                starts = np.concatenate([[0], ends[:-1]])
                sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(base + starts), pa.array(ends - starts), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(_dealt(manifest), batches, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _dealt(manifest: DataFrame) -> DataFrame:
    """(path, base), in a number of parts that adaptive execution leaves alone, so that few files aren't read by one task."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_starts(manifest).select("path", "base").repartition(parts, "path")


def count(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of some ids in all shards, from the counts in the files; planes aren't read."""
    asked = sorted(set(tokens))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for path in batch.column("path").to_pylist():
                with open_seekable(path) as source:
                    shard = Shard(source)
                    yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array([shard.count(t) for t in asked], pa.int64())], names=["token", "n"])

    found = map_arrow(_dealt(manifest).select("path"), batches, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    every = manifest.sparkSession.createDataFrame([(t,) for t in asked], "token bigint")
    return every.join(found, "token", "left").select("token", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def locate(manifest: DataFrame, token: int) -> DataFrame:
    """(doc_id, start, at): every occurrence of an id, with its document's start and its place in the document. Planes
    of shards without it aren't read."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with open_seekable(path) as source:
                    shard = Shard(source)
                    if shard.count(token):
                        places = shard.places(token)
                        owner = np.searchsorted(shard.ends, places, side="right")
                        starts = np.concatenate([[0], shard.ends[:-1]])[owner]
                        docs = pa.array(shard.docs, pa.int64()).take(pa.array(owner))
                        yield pa.RecordBatch.from_arrays([docs, pa.array(base + starts), pa.array(places - starts)], names=["doc_id", "start", "at"])

    return map_arrow(_dealt(manifest), batches, "doc_id bigint, start bigint, at bigint")
