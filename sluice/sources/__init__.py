"""Readers: an artifact tree, and tables in Parquet."""
