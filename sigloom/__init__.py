"""Spark-native k-mer signature search."""

__version__ = "0.1.0"
