"""Operators on record tables, texts and people."""
