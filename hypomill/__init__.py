"""Spark-native analytics over ranked-hypothesis (N-best) text records."""

__version__ = "0.1.0"
