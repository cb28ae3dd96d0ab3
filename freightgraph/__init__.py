"""Freight-network analytics on DataFrames."""
