"""Readers, schema gates and sinks."""
