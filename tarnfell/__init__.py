"""Outdoor-map data jobs on Spark DataFrames."""
