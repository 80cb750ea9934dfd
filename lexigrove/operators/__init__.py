"""Operators from DataFrame to DataFrame: index, ranking, Boolean sets, facets, fusion, vectors, search."""
