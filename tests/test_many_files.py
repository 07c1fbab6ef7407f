"""Files that are written in several parts and read in several splits."""

import pytest
from pyspark.sql import functions as F

from lodestone.plans import catalogue
from lodestone.sources import textio
from tests.oracle import SMALL, ask, same


@pytest.fixture
def many_parts(spark):
    """Sorted rows are written in a part a partition, as they are for larger tables, not in one."""
    wanted = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(
    "name",
    [
        "read_f2_centroids",
        "read_f3_centroids",
        "read_f4_labels",
        "read_f5_points",
        "read_f2_points",
        "read_f3_points",
        "read_f5_class_words",
        "write_f4_lines",
    ],
)
def test_files_of_many_parts(spark, many_parts, name):
    same(catalogue.queries()[name](spark, SMALL).toPandas(), ask(catalogue.oracle_sql()[name]))


def test_centroids_of_many_parts(spark, many_parts, tmp_path):
    """parts of labels are larger than the first, which has the centroids."""
    labels = spark.range(5000).select("id", F.when(F.col("id") < 1000, 1).otherwise(1_000_000).alias("cluster_id"))
    textio.write_f4(spark, str(tmp_path / "F4"), [[1.5, 2.0], [3.0, 4.25]], labels)
    assert textio.read_centroids(spark, str(tmp_path / "F4"), 2) == [[1.5, 2.0], [3.0, 4.25]]


@pytest.mark.parametrize("size", ["40", "1000000"])
def test_lines_go_by_name_not_by_size(spark, tmp_path, size):
    """Spark reads the largest files and splits first."""
    for part in range(4):
        (tmp_path / f"part-{part}.txt").write_text("".join(f"{part} {i}\n" for i in range(5 + 20 * part)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = textio.lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in got] == list(enumerate(f"{p} {i}" for p in range(4) for i in range(5 + 20 * p)))
