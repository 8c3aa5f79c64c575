"""Whole jobs made of operators, and data sets for plots."""
