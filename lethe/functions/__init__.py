"""Column functions: pattern matching, rewriting, addresses, names."""
