"""Readers for the raw exports and sinks for the results."""
