"""Catalyst expression helpers (parsing, guards, labels, formatting)."""
