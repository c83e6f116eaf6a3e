"""Operators on training text and vectors. Nothing outside this package imports it."""
