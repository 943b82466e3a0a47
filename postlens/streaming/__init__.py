"""Structured Streaming: interest over time, posting ingestion."""
