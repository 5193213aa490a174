"""Batch and streaming jobs for agent memory on Spark DataFrames."""
