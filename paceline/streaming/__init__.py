"""Structured Streaming forms of the append log."""
