"""Structured Streaming jobs over files that arrive."""
