"""Structured Streaming forms of the continuous checks."""
