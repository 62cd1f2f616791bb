"""Corpus search, classification, routing, consensus and audit jobs on Spark DataFrames."""

__version__ = "0.1.0"
