"""Retrieval-evaluation analytics on Spark DataFrames."""
