"""Registered queries: one module a theme, each with QUERIES and the SQL they must equal."""
