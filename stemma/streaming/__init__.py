"""Structured Streaming over events; the same plans run in batch."""
