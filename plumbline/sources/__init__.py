"""Readers and writers of drawing files."""
