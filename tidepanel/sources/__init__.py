"""Readers, writers and landing plans."""
