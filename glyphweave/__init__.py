"""Spark-native text categorization analytics."""

__version__ = "0.1.0"
