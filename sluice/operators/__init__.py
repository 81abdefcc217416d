"""Dataset-level checks over any DataFrames with the key columns named."""
