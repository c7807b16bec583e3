"""Structured Streaming jobs and keyed state processors."""
