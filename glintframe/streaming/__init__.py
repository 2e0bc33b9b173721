"""Structured Streaming: speech sessions."""
