"""Structured Streaming forms of the aggregates."""
