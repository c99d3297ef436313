"""Quadrille: two-dimensional vector queries and table processing on Spark DataFrames."""

__version__ = "0.1.0"
