"""Triples from N-Triples files and from tables."""
