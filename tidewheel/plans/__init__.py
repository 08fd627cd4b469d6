"""Queries as JSON: parsing into plans, and the two commands."""
