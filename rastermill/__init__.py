"""Lossy-raster analytics over tables of cells, and preparation of training text, as Spark jobs."""
