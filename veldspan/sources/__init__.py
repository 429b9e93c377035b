"""Readers of mapping files and the registry of named sources."""
