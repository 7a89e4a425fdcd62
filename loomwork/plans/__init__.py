"""Queries over the tables of an input folder, and their SQL."""
