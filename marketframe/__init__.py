"""Daily market analytics as plain Spark DataFrame functions."""
