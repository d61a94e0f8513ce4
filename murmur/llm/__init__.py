"""Operators for building training data from text; nothing outside this package imports it."""
