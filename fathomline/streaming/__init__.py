"""Structured Streaming into the log."""
