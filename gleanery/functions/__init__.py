"""Column builders: each takes Columns and returns one Column expression."""
