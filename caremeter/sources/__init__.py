"""Schemas, CSV input and the layered Parquet store."""
