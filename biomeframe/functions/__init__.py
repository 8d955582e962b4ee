"""Scalar functions as Column expressions, and the module-definition parser."""
