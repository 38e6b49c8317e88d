"""plumbrank: retrieval experiments and their comparison, on Spark DataFrames."""

__version__ = "0.1.0"
