"""Operators for preparing training data: packing, search, extraction, cleaning.

Nothing else in the library imports this subpackage. ``queries.py`` holds the
registered queries, every other module one operator with its own interface.
"""
