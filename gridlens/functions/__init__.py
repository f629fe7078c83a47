"""Column functions: plain Spark expressions, no Python UDFs."""
