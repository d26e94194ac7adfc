"""Backup and restore of whole tables."""
