"""Composed results: one function per product, built from the operators."""
