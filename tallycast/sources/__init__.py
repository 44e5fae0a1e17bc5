"""Readers, writers and demand views."""
