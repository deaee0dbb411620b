"""Brokerage deal analytics on PySpark: cleaning, relational operators and reports."""
