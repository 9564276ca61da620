"""Spatial analytics on tables of segmented objects, as lazy Spark DataFrames."""
