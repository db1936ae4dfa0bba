"""Operators for training-data pipelines: deduplication, decontamination, scoring, search, tokens."""
