"""Operators for preparing text corpora for model training.

Nothing outside this package imports it.
"""
