"""Operators on DataFrames: result cubes, graphs, text, search and statistics."""
