"""Matching, scoring, ranking, snippets and index maintenance."""
