"""Weir: a relational query toolkit on Spark DataFrames."""
