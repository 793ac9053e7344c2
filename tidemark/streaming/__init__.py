"""Structured Streaming ingest of announcement-like feeds."""
