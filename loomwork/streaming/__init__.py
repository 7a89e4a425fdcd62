"""Queries over data that arrives."""
