"""Expressions, typed attributes and finders: the query surface."""
