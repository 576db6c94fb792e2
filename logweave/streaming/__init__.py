"""Structured Streaming jobs: live multi-line assembly, the two-track ingest pipeline, live
volume, sinks."""
