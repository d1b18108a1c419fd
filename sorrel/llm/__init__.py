"""Operators for preparing language-model training data.

Nothing else in the library imports this package; ``registry`` holds the queries and their SQL.
"""
