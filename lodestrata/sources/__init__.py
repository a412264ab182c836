"""Readers of lodestrata."""
