"""Structured Streaming forms of the scoring jobs."""
