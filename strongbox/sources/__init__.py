"""Readers of files, archives and bulk data."""
