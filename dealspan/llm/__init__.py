"""Operators on documents, URLs and vectors for preparing training data."""
