"""Operators for large-scale training-data preparation; nothing outside this package imports it."""
