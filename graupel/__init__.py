"""Semantic text analytics on Spark: text, vectors, grouping, matching and ranking over DataFrames."""

__version__ = "0.1.0"
