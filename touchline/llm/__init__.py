"""Operators that prepare records and texts for training data. Nothing outside this package imports it."""
