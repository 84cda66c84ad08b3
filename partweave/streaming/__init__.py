"""Structured Streaming extensions (the reference system has no streams)."""
