"""Spark operators for interactive classification of very large object tables."""
