"""Set-level and row-level operators on DataFrames."""
