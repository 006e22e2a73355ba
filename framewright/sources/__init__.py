"""Readers, synthetic frame sources and sinks."""
