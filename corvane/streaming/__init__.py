"""Structured Streaming operators; feeds has them all."""
