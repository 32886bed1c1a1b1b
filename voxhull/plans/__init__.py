"""Composite pipelines, and the catalogue of named queries."""
