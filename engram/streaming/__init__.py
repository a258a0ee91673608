"""Structured Streaming versions of the roll-ups."""
