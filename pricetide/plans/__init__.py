"""Registered queries: the operators bound to the given tables, each with an equivalent in plain SQL."""
