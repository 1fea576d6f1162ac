"""Streams of reads."""
