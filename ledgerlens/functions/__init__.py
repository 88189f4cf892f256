"""Column-level expression builders (no DataFrames, no actions)."""
