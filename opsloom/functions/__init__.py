"""Column functions: text, numbers, dates."""
