"""Composed queries and their catalogue."""
