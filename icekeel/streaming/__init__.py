"""Maintenance driven by Structured Streaming."""
