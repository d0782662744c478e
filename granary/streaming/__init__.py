"""Structured Streaming over append-only call logs."""
