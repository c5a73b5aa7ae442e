"""bitloom: byte streams, typed fields and metadata as Spark DataFrames."""

__version__ = "0.1.0"
