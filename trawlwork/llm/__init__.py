"""Operators for preparing large-scale training data."""
