"""Column functions: text sizes, scores, vectors, JSON and time helpers, model hooks."""
