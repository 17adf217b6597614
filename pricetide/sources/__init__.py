"""Landed payloads to listings, and user-supplied inputs to clean tables."""
