"""Tracewell: a Spark-native engine for source-corpus observability analytics."""

__version__ = "0.1.0"
