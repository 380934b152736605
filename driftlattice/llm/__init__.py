"""Operators of a training-data pipeline: one module each, with queries and SQL in `registry`."""
