"""Composed plans: the fitted flow model and the registered queries."""
