"""Operators of a training-data pipeline: packing, scoring, search, dedup, language, archives."""
