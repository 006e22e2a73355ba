"""Codec stages as DataFrame operators."""
