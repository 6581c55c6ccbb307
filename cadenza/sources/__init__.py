"""Readers, writers and file-inventory joins."""
