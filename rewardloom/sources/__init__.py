"""Readers, writers and the feeds derived from the driver's tables."""
