"""Operators of a training-data pipeline: formatting, scoring, tokens, packing, placement, near-duplicates."""
