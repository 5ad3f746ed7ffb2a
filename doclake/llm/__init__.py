"""Operators for preparing training data: tokens, filters, duplicates, search.

Nothing else in the library imports this subpackage.
"""
