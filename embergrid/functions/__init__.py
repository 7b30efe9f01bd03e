"""Column functions: numbers, text, links and dates."""
