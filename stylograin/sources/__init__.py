"""Readers, column normalisation and sinks."""
