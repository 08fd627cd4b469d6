"""Operators for preparing training text, with their registered queries in ``queries``.

Nothing else in the library imports this package; deleting it leaves the rest working.
"""
