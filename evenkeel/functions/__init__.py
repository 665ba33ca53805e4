"""Column-level building blocks: text, pair counts, vectors, hashing, formatting."""
