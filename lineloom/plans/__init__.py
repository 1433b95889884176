"""Plans of the line-evidence engine."""
