"""Operators of a training-data pipeline: deduplication, scoring, filtering, sharding, tokenised output and packing."""
