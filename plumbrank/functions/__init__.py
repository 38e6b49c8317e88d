"""Column expressions: tokenisers, scoring formulas, predicates."""
