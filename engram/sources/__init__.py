"""Readers, writers and table-level sinks."""
