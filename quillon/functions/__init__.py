"""Column expressions for text and query language."""
