"""Structured Streaming forms of the ingest and feedback operators."""
