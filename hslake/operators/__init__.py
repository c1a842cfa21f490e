"""Operators of the journal engine."""
