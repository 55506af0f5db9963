"""Spherical Voronoi analytics on Spark DataFrames."""
