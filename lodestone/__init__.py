"""Spark-native vector analytics: exact nearest neighbours, Lloyd's k-means and their text formats."""
