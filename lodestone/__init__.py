"""Spark-native analytics over document collections, tables and event streams."""

__version__ = "0.1.0"
