"""Structured Streaming versions of the discovery jobs."""
