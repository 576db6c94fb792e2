"""Readers, test-table views and sinks."""
