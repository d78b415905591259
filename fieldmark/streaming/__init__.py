"""Incremental surfaces as Structured Streaming."""
