"""Structured Streaming versions of the keyed-state operators (extensions)."""
