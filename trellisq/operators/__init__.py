"""Joins, paths and the translation of the algebra to DataFrames."""
