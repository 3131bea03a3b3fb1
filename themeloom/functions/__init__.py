"""Column builders and fixed values."""
