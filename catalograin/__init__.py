"""Specification search and catalogue analytics on Spark DataFrames."""
