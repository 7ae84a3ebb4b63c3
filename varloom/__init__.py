"""Variant prioritisation and genomic-interval analytics on Spark DataFrames."""
