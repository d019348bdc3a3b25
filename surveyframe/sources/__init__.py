"""Readers, writers and hooks."""
