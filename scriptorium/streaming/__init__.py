"""Structured Streaming over append-only logs and events."""
