"""Column expressions: names, text, arrays."""
