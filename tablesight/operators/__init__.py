"""Operators: each takes DataFrames and plain parameters and returns a lazy DataFrame."""
