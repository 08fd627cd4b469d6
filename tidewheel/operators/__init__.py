"""Operators on series, reports, aggregations and ordered rows, lowered to DataFrames."""
