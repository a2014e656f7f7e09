"""Operators: DataFrames in, DataFrame out; column names are parameters."""
