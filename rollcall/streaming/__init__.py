"""Structured Streaming versions of loading and statistics."""
