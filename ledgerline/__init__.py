"""Equity-research analytics on PySpark: DataFrames in, DataFrames out."""
