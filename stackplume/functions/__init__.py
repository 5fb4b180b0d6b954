"""Column expression builders (no actions, no DataFrames)."""
