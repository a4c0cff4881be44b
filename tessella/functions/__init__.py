"""Scalar and array expressions."""
