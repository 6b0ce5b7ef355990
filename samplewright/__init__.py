"""Resampling statistics and training-data operators for Spark DataFrames."""
