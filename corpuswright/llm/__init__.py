"""Operators for training-data pipelines: deduplication, decontamination, scoring, filtering and mixing."""
