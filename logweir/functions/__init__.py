"""Column functions: each takes columns and gives a column, all inside Catalyst."""
