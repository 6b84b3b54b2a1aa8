"""Spark-native retrieval, clustering and record-processing engine."""

__version__ = "0.1.0"
