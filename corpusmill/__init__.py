"""Spark-native corpus analytics, hybrid retrieval and training-data processing."""

__version__ = "0.1.0"
