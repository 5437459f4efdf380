"""Listening-behaviour analytics on Spark DataFrames."""
