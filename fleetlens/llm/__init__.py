"""Operators of a training-data pipeline over documents, pages and benchmark items.

Nothing else in the library imports this subpackage. ``queries`` holds the
registered queries and their oracle SQL.
"""
