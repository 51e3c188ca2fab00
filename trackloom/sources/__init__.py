"""Readers, sinks, schemas and views."""
