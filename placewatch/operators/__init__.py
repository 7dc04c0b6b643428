"""Set-oriented operators: DataFrames and column names in, DataFrames out."""
