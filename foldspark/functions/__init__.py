"""Statistics and column functions."""
