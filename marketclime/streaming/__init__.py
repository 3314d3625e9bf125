"""Structured Streaming forms of the incremental ingest."""
