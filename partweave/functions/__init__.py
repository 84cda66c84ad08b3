"""Column -> Column functions: identifier normalisers, similarities, cost and confidence."""
