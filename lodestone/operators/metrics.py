"""Comparison of two labelings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ratio): the share of a's rows (id, cluster_id) that have the same label in b. Null if a is empty."""
    other = b.select("id", F.col("cluster_id").alias("_other"))
    joined = a.select("id", "cluster_id").join(other, "id", "left")
    return joined.agg(F.avg(F.coalesce(F.col("cluster_id") == F.col("_other"), F.lit(False)).cast("double")).alias("ratio"))
