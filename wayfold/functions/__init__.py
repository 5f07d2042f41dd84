"""Column functions, and their registration for SQL."""
