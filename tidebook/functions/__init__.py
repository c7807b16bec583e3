"""Column functions: book rules, quality predicates, text and time."""
