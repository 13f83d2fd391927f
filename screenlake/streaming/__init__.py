"""Streams that are upserted into a project."""
