"""Functions of the line-evidence engine."""
