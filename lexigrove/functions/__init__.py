"""Column functions: text analysis, predicates, vectors, typo distances."""
