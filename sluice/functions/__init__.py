"""Column functions: fixed values, text patterns, JSON values, paths and timestamps."""
