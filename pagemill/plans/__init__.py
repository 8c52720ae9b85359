"""Composed workflows built from the operators."""
