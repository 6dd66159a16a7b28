"""Registered queries with their SQL, over inputs derived from the given tables."""
