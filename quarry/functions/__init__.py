"""Column expressions: strings, paths, vectors, routing rules and templates."""
