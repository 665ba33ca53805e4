"""Structured Streaming ingest of answer files."""
