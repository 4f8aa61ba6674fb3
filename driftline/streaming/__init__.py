"""Structured Streaming forms of the hourly bucket and the de-duplication."""
