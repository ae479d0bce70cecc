"""Operators of a training-data pipeline: formatting, filtering, dedup, scoring, packing, sharding."""
