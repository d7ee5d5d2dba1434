"""Operators for text and training-data preparation. Nothing else in the library imports this package."""
