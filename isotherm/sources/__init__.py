"""Readers of gridded records."""
