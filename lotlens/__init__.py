"""Listing-marketplace analytics on PySpark DataFrames."""
