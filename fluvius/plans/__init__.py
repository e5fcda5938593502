"""Compositions of operators: whole queries."""
