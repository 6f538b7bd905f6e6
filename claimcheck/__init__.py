"""Spark-native claim-faithfulness pipeline: clean, route, retrieve, score, decide, evaluate."""

__version__ = "0.1.0"
