"""Session defaults and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Whether a query's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out over all cores if the scan alone can't (one small file); large scans pass as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset, a temporary folder is
    set for a session on one machine; on a cluster it would be no shared one, and this fails."""
    found = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written within are deleted at the end, but for lasting ones, which pass to the scope around it."""
    held: list[DataFrame] = []
    _scopes.append(held)
    try:
        yield
    finally:
        _scopes.remove(held)
        discard(*held)


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed within are deleted at its end; the session's own setting comes back."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: evaluated once, and survives lost executors. The table
    takes the place of the shuffles on its way, whose files go."""
    path = fresh_path(df.sparkSession, name)
    with _shuffles_go(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    around = _scopes[:-1] if lasting else _scopes
    if around:
        around[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing lazy depends on any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
