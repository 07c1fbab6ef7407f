"""Places of rows without a global window: places in partitions or splits plus the rows of all before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

_LOCAL = (1 << 33) - 1  # bits of monotonically_increasing_id() that count within a partition


def _offset(marked: DataFrame, part: Column, at: Column, name: str) -> DataFrame:
    keyed = marked.withColumns({"_part": part, "_in_part": at})
    counts = keyed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return keyed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_in_part")).drop("_part", "_in_part", "_before", "_mark")


def numbered(scan: DataFrame, name: str) -> DataFrame:
    """scan plus the place of each row, from 0: files go by path, rows as they stand in them. For frames straight from
    files, whose partitions are the same each time. Spark deals out files and their splits by size, so rows are counted
    by split and a partition's number says nothing; a split's rows follow each other in one partition."""
    split = ["_path", "_start"]
    marked = scan.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_mark"))
    counts = marked.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), F.min("_mark").alias("_first"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    offsets = counts.select(*split, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return marked.join(F.broadcast(offsets), split).withColumn(name, F.col("_mark") + F.col("_shift")).drop(*split, "_mark", "_shift")


def ranked(df: DataFrame, name: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """df plus the place of each row, from 0, in the given order, and the written table that it reads. Range partitions
    of the whole order are balanced even where its first column is not."""
    table = written(df.orderBy(*order).withColumn("_mark", F.monotonically_increasing_id()), "ranked")
    return _offset(table, F.shiftright("_mark", 33), F.col("_mark").bitwiseAND(F.lit(_LOCAL)), name), table
