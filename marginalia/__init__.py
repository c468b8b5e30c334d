"""Corpus preparation, retrieval, evaluation and monitoring operators on Spark DataFrames."""

__version__ = "0.1.0"
