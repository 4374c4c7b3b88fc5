"""Column builders: tokens, scores, paths, time."""
