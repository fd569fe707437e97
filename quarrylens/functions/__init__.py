"""Column expressions and logical types."""
