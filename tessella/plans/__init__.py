"""Configurations and jobs."""
