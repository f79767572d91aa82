"""Structured Streaming forms of validation and scoring."""
