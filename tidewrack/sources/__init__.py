"""Readers, writers and extractors."""
