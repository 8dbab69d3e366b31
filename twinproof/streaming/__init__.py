"""Structured Streaming jobs built from the same row-local operators."""
