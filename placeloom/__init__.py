"""Spark-native engine for multilingual place-name data."""

__version__ = "0.1.0"
