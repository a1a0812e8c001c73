"""Readers of catalogs, archives and stored tables."""
