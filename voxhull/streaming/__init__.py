"""Stateless fields and windowed sums over streams of points."""
