"""Behavioural analytics on Spark DataFrames."""
