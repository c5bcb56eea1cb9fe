"""Spatial and batch analytics on Spark DataFrames."""
