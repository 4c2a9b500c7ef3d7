"""Operators for preparing training text at scale, with their registered queries.

Nothing else in the library imports this subpackage.
"""
