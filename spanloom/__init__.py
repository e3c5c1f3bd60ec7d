"""Verifiable span extraction, batch planning and corpus tables on Spark DataFrames."""

__version__ = "0.1.0"
