"""Structured Streaming jobs (optional extension: the daily roll-up)."""
