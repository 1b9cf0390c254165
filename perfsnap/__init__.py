"""Performance-snapshot analytics as plain Spark DataFrame functions."""
