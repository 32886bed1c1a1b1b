"""Operators on meshes, points, graphs and fits. Each takes DataFrames and gives DataFrames."""
