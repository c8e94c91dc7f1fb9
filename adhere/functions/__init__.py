"""Column expressions. All of them are built-in Catalyst functions."""
