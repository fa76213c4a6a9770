"""A PySpark-native engine for experiment grids, result cubes, graphs, text and statistics."""
