"""Sources of the line-evidence engine."""
