"""Scans of document folders and of the audit table."""
