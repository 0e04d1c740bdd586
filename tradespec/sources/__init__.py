"""Readers and writers for the trade tables."""
