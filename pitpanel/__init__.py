"""Point-in-time panel analytics on PySpark DataFrames."""

__version__ = "0.1.0"
