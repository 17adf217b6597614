"""Operators for preparing training corpora: scoring, deduplication, searching, encoding and packing.

Nothing else in the library imports this subpackage.
"""
