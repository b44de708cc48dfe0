"""Reading and writing logs."""
