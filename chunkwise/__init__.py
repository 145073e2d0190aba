"""Document retrieval analytics on Spark DataFrames: scan, structure, chunk, store, search and evaluate."""

__version__ = "0.1.0"
