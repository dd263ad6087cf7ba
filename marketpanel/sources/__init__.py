"""Readers, contracts, bindings and sinks."""
