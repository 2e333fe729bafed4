"""Operators over DataFrames of documents and lines."""
