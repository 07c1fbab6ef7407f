"""What the operators share: the shared folder, written tables, and zero-copy text access in Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

from ..session import discard, fresh_path, scratch, shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids (8 bytes each, some 20 in Spark's table) up to which a set of ids is broadcast; beyond it, joins are shuffled.
BROADCAST_IDS = 1_000_000


def by_ids(df: DataFrame, key: str, ids: DataFrame, how: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """df joined (inner, left, left_semi, left_anti) to ids (id, ..), a written table with a row an id, which is counted:
    broadcast up to ``limit`` rows. As ids is written, the shuffled join stands alone on its exchanges, and adaptive
    execution can split a key that a large share of df has."""
    wanted = ids.withColumnRenamed("id", key)
    return df.join(broadcast(wanted) if ids.count() <= limit else wanted, key, how)


#: Rows and bytes in an Arrow batch at most: they bound what a task holds of texts at once, on either side.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def _give_back() -> None:
    """Returns freed memory to the system; workers live on between tasks, and what they keep adds up."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, batches: Callable, schema: str) -> DataFrame:
    """mapInArrow in batches of BATCH_ROWS and BATCH_BYTES whose workers find this package: beside the path that
    executors have of their own (--py-files on a cluster), they look where the driver has it.

    Spark has these bounds and that path for a session alone, so larger bounds of the session are lowered, for good."""
    spark = df.sparkSession
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    most = spark.conf.get(_BYTES).rstrip("b")
    if not most.isdigit() or not 0 < int(most) <= BATCH_BYTES:  # or with a unit
        spark.conf.set(_BYTES, f"{BATCH_BYTES}b")

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from batches(stream)
        finally:
            _give_back()

    return df.mapInArrow(task, schema)


def utf8_views(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of every row of a string column, None for null, without copies."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield raw[at[i] : at[i + 1]] if valid[i] else None
