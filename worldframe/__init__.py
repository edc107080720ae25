"""worldframe: cell-based world maps as DataFrames."""
