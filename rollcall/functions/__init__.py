"""Column functions: dates, text, and expression helpers."""
