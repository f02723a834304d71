"""Palimpsest: long-document text analytics on Spark DataFrames."""
