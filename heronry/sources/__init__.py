"""Readers, format detection, document parsers and sinks."""
