"""Readers of what providers deliver: catalogs of page files, and cells in nested JSON."""
