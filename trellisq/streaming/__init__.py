"""Triples that arrive over time."""
