"""Column expressions: header names, cell values, display text."""
