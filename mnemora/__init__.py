"""Layered-memory analytics and corpus processing on Spark DataFrames."""
