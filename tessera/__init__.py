"""Spark jobs over media containers, pixel grids and symbol sequences held as tables."""
