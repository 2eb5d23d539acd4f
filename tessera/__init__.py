"""Labelled raster streams as PySpark DataFrames."""
