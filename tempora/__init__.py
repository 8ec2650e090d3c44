"""Temporal data-warehouse operators on Spark DataFrames."""
