"""Operators for the training-data pipeline; nothing outside this package imports it."""
