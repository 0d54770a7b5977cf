"""Retrieval operators: each takes and returns DataFrames, many queries at once."""
