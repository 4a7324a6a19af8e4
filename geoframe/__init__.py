"""Satellite-image geometry on Spark DataFrames."""
