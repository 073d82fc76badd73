"""Data-processing operators: pure functions from DataFrames to DataFrames."""
