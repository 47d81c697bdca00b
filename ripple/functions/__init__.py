"""Column expressions: predicates, scalar functions and the rule tables they use."""
