"""Operators for preparing text corpora at scale. Nothing outside this package imports it."""
