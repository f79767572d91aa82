"""Readers, writers and artifact tables."""
