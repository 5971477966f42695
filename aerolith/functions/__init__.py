"""Column builders: plain Spark expressions, so Catalyst sees all of them."""
