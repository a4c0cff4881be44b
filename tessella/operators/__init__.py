"""Relational operators: statistics, selection, sampling, joins, evaluation and calibration."""
