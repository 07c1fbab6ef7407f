"""Stateless scoring of a stream: assignment is a projection, so it needs no watermark and no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.kmeans import Matrix, assign


def assign_stream(spark: SparkSession, source: str, schema: str, centroids: Matrix, sink: str, checkpoint: str) -> StreamingQuery:
    """Labels the Parquet files that arrive in ``source`` (id, features) and appends (id, cluster_id) to ``sink``."""
    points: DataFrame = spark.readStream.schema(schema).parquet(source)
    labelled = assign(points, centroids).select("id", "cluster_id")
    return labelled.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
