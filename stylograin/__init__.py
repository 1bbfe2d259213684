"""Spark analytics for labelled text and syntax-tree samples."""

__version__ = "0.1.0"
