"""Column expressions: time, text, names, paths, globs, JSON and fuzzy scores."""
