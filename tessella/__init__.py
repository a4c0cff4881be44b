"""Tessella: interpretable feature algebra, models and evaluation on PySpark DataFrames."""
