"""Relational operators on DataFrames: joins, grouping, windows over row order and reshaping."""
