"""Operators on DataFrames: each takes frames and parameters and returns a lazy frame."""
