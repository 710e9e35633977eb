"""Structured Streaming form of the change-record operators."""
