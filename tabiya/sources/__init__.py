"""Scans of records and change logs, collection layouts and sinks."""
