"""Streaming of the journal engine."""
