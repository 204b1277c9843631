"""Column functions on RDF terms."""
