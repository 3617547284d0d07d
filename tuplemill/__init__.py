"""Tuple co-occurrence analytics on Spark DataFrames."""
