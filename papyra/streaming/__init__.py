"""Structured Streaming over status events."""
