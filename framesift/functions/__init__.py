"""Column builders: scalar rules as built-in Spark expressions."""
