"""Weftline: web pages and training text as DataFrames."""
