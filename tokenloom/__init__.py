"""Spark-native preparation, tokenisation, packing and evaluation of text corpora."""

__all__ = ["functions", "operators", "sources", "plans", "streaming", "registry"]
