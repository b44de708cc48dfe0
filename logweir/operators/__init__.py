"""Operators on lines and entries: DataFrames in, DataFrames out."""
