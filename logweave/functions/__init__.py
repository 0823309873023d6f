"""Column expressions: timestamps, labels, entity ids, tokens."""
