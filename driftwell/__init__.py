"""Sketch-based sensor analytics, batch and streaming, on PySpark DataFrames."""

__version__ = "0.1.0"
