"""Operators of a training-data pipeline: filtering, scoring, dedup, archives, packing, chat."""
