"""Catalog and recommendation analytics on Spark DataFrames."""
