"""Readers that return feature DataFrames."""
