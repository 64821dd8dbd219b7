"""Patterns and their plans."""
