"""Column builders: vectors, attributes, text."""
