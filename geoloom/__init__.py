"""Geospatial analytics on Spark DataFrames."""
