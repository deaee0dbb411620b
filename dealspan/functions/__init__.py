"""Column expressions: numbers, dates, text and bins."""
