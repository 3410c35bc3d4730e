"""Incremental extraction, high-water marks and the streaming forms of append and upsert."""
