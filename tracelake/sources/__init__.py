"""Readers and writers of the canonical tables."""
