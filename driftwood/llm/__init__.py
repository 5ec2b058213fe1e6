"""Operators of a training-data pipeline: scoring, filtering, de-duplication, search and packing."""
