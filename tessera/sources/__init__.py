"""Where graphs come from and where they go: N-Triples, relational tables, databases."""
