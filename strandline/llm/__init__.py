"""Operators for preparing language-model training data, with their queries.

Nothing else in the library imports this package.
"""
