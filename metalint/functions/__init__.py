"""Scalar functions, all plain Column expressions."""
