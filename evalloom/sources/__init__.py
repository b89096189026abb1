"""Readers, writers and hooks to the outside."""
