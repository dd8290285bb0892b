"""Helpers that operators share."""
