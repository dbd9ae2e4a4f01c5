"""Column expressions: numeric conventions, geometry and names."""
