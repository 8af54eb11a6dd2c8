"""Column functions (scalar operators)."""
