"""Structured Streaming runners and metrics."""
