"""Column level functions."""
