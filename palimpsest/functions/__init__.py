"""Column-level building blocks: text, vectors, time and scores."""
