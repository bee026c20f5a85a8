"""Incremental ingest and the continuously kept status log."""
