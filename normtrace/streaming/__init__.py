"""Incremental causal checks with Structured Streaming."""
