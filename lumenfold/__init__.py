"""Lumenfold: document-field analytics on Spark DataFrames."""
