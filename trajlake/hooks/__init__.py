"""Ready-made hooks, named by their dotted paths."""
