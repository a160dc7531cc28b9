"""Incremental tables fed by Structured Streaming."""
