"""Graph operators: access paths, statistics, pattern matching, intersection, results."""
