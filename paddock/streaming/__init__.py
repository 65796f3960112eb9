"""Structured Streaming variants of the ordered and as-of operators."""
