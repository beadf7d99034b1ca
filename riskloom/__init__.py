"""Tabular risk analytics on Spark DataFrames."""
