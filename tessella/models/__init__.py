"""Models: tables of weights, scored by joins and aggregation, and explained feature by feature."""
