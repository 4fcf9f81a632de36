"""Column-level expressions: strings, code, JSON schemas, vectors, scoring."""
