"""Graded-corpus analytics on Spark DataFrames."""
