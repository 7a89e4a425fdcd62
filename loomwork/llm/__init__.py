"""Operators for preparing language-model training data.

Each module holds one operator with its general interface; ``catalogue`` holds
the thin queries that bind the operators to the tables of an input folder.
Nothing outside this subpackage imports it.
"""
