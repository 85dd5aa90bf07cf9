"""Operators that prepare text for training large models. Nothing else in the library imports this package."""
