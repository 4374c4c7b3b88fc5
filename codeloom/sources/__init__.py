"""Readers: tables, source trees, event logs, and the extraction of entities from source text."""
