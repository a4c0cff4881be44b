"""Queries over the test tables, by operator."""
