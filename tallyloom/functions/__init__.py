"""Column expressions and small Python table functions."""
