"""Column functions: built-ins where Spark has them, Arrow-backed Python where it hasn't."""
