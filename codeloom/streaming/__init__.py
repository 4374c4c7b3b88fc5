"""Structured Streaming jobs over the action log and file events."""
