"""Hybrid search over DataFrames: vectors, text and attributes, planned by Catalyst."""
