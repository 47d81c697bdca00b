"""Change-impact analysis over source repositories and other dependency graphs, on Spark DataFrames."""

__version__ = "0.1.0"
