"""Structured Streaming operators over job events."""
