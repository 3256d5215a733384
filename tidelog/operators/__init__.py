"""Operators on logs, each a function from DataFrames to a DataFrame."""
