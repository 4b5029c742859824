"""Retail price analytics on Spark DataFrames."""
