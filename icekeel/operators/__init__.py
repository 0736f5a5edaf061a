"""Relational operators over table metadata and data; every one takes DataFrames and returns a DataFrame."""
