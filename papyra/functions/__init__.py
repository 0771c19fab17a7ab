"""Column expressions, and Arrow-batched functions where Spark has no built-in."""
