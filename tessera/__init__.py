"""Spark-first scoring, grouping and selection analytics over time-ordered collections."""

__version__ = "0.1.0"
