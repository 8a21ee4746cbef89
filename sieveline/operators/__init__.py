"""Transforms of DataFrames."""
