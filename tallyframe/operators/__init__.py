"""Operators on entities, features, labels, scores and runs."""
