"""Column expressions and row-wise functions."""
