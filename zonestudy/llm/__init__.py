"""Operators for preparing training data: search, scoring, joins, encoding, output and filters over text tables."""
