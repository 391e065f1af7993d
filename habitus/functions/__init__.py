"""Column-level building blocks: patterns, paths, languages, text, time."""
