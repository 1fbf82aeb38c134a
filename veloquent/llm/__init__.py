"""Operators for training-data work on texts and for its algorithms; nothing outside this package imports it."""
