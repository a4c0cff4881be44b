"""Transforms and scoring on streams."""
