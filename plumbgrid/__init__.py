"""Spatial, raster, rule-driven and store analytics on PySpark."""
