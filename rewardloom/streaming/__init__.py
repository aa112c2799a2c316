"""Structured Streaming forms of the scoring and metric operators."""
