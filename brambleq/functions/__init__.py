"""Column expressions and type algebra."""
