"""Structured Streaming jobs over job events and incoming listing files."""
