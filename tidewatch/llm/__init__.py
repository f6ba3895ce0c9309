"""Operators that a large training-data pipeline needs. Nothing outside this package imports it."""
