"""Column expressions: geometry, predicates, text formats, grids and links."""
