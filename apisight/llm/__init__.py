"""Operators for training-data pipelines: one module each, all on Spark DataFrames."""
