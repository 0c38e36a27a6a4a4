"""Sequence-collection analytics planned on Spark DataFrames."""
