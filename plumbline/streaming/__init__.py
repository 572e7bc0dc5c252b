"""Streaming forms of the narrow operators."""
