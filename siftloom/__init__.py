"""Similarity-based deduplication of large corpora on Apache Spark."""

__version__ = "0.1.0"
