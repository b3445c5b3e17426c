"""Operators for training-data work on packet texts. Nothing outside this package imports it."""
