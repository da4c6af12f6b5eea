"""Column expressions: scores, draws, canonical configs, vectors."""
