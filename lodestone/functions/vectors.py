"""Point frames: ``id bigint, features array<double>`` with an optional ``label int``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def points(df: DataFrame, id_col: str, features: Column, label: str | None = None) -> DataFrame:
    columns = [F.col(id_col).cast("bigint").alias("id"), features.cast("array<double>").alias("features")]
    return df.select(*columns, *([F.col(label).cast("int").alias("label")] if label else []))


def require_dimension(df: DataFrame, d: int) -> DataFrame:
    """Fails the job on a vector that is null or hasn't d elements; such a row would otherwise get a null distance, which sorts first."""
    ok = F.col("features").isNotNull() & (F.size("features") == d)
    message = F.concat(F.lit(f"vector without {d} elements, id "), F.col("id").cast("string"))
    return df.withColumn("features", F.when(ok, F.col("features")).otherwise(F.raise_error(message).cast("array<double>")))


def vector_of(df: DataFrame, point_id: int) -> list[float]:
    """One vector, fetched by id with the filter pushed to the scan."""
    row = df.filter(F.col("id") == point_id).select("features").first()
    if row is None:
        raise LookupError(f"no point has id {point_id}")
    return list(row[0])


def long_form(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, dim, value), a row per coordinate."""
    return df.select(key, F.posexplode(vector).alias("dim", "value"))


def transpose(df: DataFrame) -> DataFrame:
    """Dimension-major form: one row per dimension with the values in id order.

    A row of the result is as long as the frame, so this form suits file exchange of bounded frames only."""
    cells = df.select("id", F.posexplode("features").alias("dim", "value"))
    ordered = F.array_sort(F.collect_list(F.struct("id", "value")))
    return cells.groupBy("dim").agg(F.transform(ordered, lambda c: c["value"]).alias("values"))


def fixed(x: Column, places: int) -> Column:
    """A double with this many decimals as C's printf writes it: the value itself is rounded, a tie to the even digit.
    format_string would round the shortest digits that name the value, ties up. From 2^63 on, digits past the 17th are 0."""
    shown = lambda v: F.call_function("format_number", v, F.lit("0." + "0" * places))
    size = F.abs(x)
    whole = F.floor(size)
    part = shown(size - whole)  # 0 or, rounded up, 1 and its decimals
    apart = F.concat(F.when(x < 0, "-").otherwise(""), (whole + part.substr(1, 1).cast("bigint")).cast("string"), part.substr(2, places + 1))
    # beyond that size the shortest digits may end before the last place
    apart_from = 2.0**53 / 10 ** (places + 1)
    return F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x < 0, "-inf").otherwise("inf")).when((size >= apart_from) & (size < 2.0**63), apart).otherwise(shown(x))
