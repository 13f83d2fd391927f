"""Scores, metrics, reports, lookups, upserts, identity and citations: DataFrames in, DataFrames out."""
