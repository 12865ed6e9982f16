"""Readers, writers and the small fixed dimension tables."""
