"""Micro-batch ingest with Structured Streaming."""
