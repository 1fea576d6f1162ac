"""Relational and graph operators over strings."""
