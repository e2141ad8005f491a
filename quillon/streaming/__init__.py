"""Incremental ingest from streams."""
