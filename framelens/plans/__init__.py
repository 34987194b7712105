"""Operator chains: feature building, training grid, scoring, and the query catalogue."""
