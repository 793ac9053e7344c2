"""Typed scans, table contracts and sinks."""
