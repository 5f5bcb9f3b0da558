"""Spark jobs for string-kernel learning, string design and the report tables around them."""
