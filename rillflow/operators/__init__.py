"""Operators on cell tables."""
