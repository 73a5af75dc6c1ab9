"""Column expressions: keys, names, locations and patterns."""
