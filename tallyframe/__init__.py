"""Evaluation analytics on Spark DataFrames: scoring, accounting, statistics, comparison, agreement."""

__version__ = "0.1.0"
