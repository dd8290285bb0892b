"""Operators: one module a theme."""
