"""Operators of the line-evidence engine."""
