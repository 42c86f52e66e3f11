"""Elementwise functions and reductions as Spark columns."""
