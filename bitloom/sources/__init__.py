"""Readers that turn files and tables into DataFrames."""

from bitloom.sources.tables import checkpoint, read_table

__all__ = ["checkpoint", "read_table"]
