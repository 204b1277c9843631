"""Query text to syntax tree, and syntax tree to join order."""
