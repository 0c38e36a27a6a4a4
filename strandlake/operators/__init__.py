"""Relational and analytical operators: each is a function of DataFrames and parameters."""
