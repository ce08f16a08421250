"""Structured Streaming counterparts of the event operators."""
