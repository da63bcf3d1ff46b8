"""Readers, bus entries and sinks."""
