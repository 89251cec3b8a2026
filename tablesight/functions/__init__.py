"""Column-level helpers: nulls, expressions, text, durable storage of intermediate results."""
