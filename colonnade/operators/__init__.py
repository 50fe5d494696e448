"""Statements as DataFrame plans: predicates, SELECT, mutations."""
