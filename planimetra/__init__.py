"""Planar geometry, spatial search, graphs, hierarchies and curves on Spark DataFrames."""
