"""Column expressions and joins that make terms and statements."""
