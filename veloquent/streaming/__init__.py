"""Structured Streaming forms of the windowed counters."""
