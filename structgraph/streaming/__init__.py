"""Structured Streaming re-index path."""
