"""Column expressions: geometry, mechanics, names, literature tables."""
