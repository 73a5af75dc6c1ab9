"""Typed dependency graphs as Spark DataFrames: operators, sources, functions, plans and streams."""

__version__ = "0.1.0"
