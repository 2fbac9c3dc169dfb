"""Operators of a training-data pipeline: deduplication, filters, mixing, archives and language models."""
