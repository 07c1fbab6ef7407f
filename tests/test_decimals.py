"""Decimals are those of C's printf, which the SQL and the reference write."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.plans import catalogue
from tests.oracle import ask, same

TIES = [0.0078125, -0.0078125, 3.0078125, 0.0234375, 0.00048828125, 1.00146484375, 0.1234565, 900.0000005, 0.9999995]
ODD = [0.0, -0.0, 1e-9, -1e-9, 1e15 / 7, -1e15 / 7, 12345678.1, 4294967295.9999999, 2.0**53 + 2, 2.0**62, float("nan"), float("inf"), float("-inf")]


@pytest.mark.parametrize("places", [6, 10])
def test_decimals_are_those_of_printf(spark, places):
    values = [*TIES, *ODD, *(k / 2**p for p in (7, 11, 13) for k in range(-300, 300, 7))]
    df = spark.createDataFrame([(values,)], "v array<double>")
    assert df.select(F.transform("v", lambda x: vectors.fixed(x, places))).first()[0] == [f"{x:.{places}f}" for x in values]


@pytest.mark.parametrize("name", ["points_transpose", "write_f6_lines", "write_coordinates_lines"])
def test_files_of_ties_equal_sql(spark, tmp_path, name):
    rows = [(i, [(2 * i + j + 1) / 2048 for j in range(4)], i % 3) for i in range(20)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    same(catalogue.queries()[name](spark, str(tmp_path)).toPandas(), ask(catalogue.oracle_sql()[name], str(tmp_path)))
