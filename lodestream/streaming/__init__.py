"""Structured Streaming twins of the per-key monitors."""
