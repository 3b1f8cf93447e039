"""Operators for preparing training data: scoring, filtering, de-duplication, encoding.

Nothing else in the package imports this subpackage.
"""
