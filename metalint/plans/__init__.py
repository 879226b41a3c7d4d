"""Whole plans: estate pipelines, and the operators applied to relational tables."""
