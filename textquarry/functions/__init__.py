"""Column-level building blocks: patterns, grams, paths, text, content types."""
