"""Structured Streaming forms of the session operators and the upsert sink."""
