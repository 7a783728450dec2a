"""The library's own algebra: DataFrames in, DataFrames out."""
