"""Sequence-similarity search and the data processing around it, on Spark."""
