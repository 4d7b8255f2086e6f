"""Queries by subject, each with its SQL."""
