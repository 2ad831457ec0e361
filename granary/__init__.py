"""Irregular observation series, rasters and label tables as PySpark DataFrame operators."""
