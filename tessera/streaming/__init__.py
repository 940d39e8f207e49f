"""Structured Streaming wrappers of the incremental operators."""
