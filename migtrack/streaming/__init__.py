"""Structured Streaming: incremental test-result log."""
