"""Spatial, trajectory, time-series, vector, graph, image and text operators as PySpark DataFrame transformations."""
