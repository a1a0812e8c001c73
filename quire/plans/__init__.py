"""Flows that chain operators, and the queries over the given tables."""
