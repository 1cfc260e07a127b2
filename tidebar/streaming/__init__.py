"""Structured Streaming forms of the stateful rules; the batch forms are their oracle."""
