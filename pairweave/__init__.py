"""Correlation networks over many independent studies, and corpus preparation, on Spark."""
