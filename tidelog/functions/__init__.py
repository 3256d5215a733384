"""Column functions: routing, names and patterns, values."""
