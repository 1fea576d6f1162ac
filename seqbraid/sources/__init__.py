"""Readers and renderers."""
