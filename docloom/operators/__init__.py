"""Operators on the tables of schema: each takes and returns DataFrames keyed by document."""
