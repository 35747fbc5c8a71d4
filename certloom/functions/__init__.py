"""Column builders. Everything here is a built-in Spark expression."""
