"""Retail analytics operators for Spark: DataFrames and parameters in, one DataFrame out."""
