"""Structured Streaming forms; each has a batch twin of the same rows."""
