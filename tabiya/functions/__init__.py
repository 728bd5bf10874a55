"""Column functions: predicates, text analysis, record rules."""
