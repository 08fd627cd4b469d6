"""Declarative time-series analytics on Spark."""
