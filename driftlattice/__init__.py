"""Structural analytics on Spark DataFrames."""
