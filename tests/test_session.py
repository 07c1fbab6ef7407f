import time
from pathlib import Path

from pyspark.sql import functions as F

from lodestone import session


def _shuffle_files(spark) -> set[str]:
    disks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {str(f) for d in disks for f in Path(d).rglob("shuffle_*.data")}


def test_written_tables_leave_no_shuffle_files(spark):
    before, own = _shuffle_files(spark), spark.conf.get(session.CLEANUP, "false")
    held = session.written(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "grouped")
    for _ in range(50):  # files are deleted beside the query
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert _shuffle_files(spark) <= before
    assert held.count() == 100
    assert spark.conf.get(session.CLEANUP, "false") == own
    session.discard(held)
