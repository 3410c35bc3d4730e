"""Column builders: extraction windows, scalar helpers and the type table."""
