"""Resampling, projection, join and regression operators on DataFrames."""
