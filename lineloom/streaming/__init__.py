"""Streaming of the line-evidence engine."""
