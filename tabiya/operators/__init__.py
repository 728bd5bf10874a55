"""Operators on collections: search, full text, translation, enrichment, applying changes."""
