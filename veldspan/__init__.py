"""Spark-native semantic mapping analytics."""

__version__ = "0.1.0"
