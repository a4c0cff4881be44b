"""Trainers. Sums over data are aggregations; only updates that depend on order run in Python, one bag a partition."""
