"""Streaming arrival of alignment files."""
