"""Operators of a training-data pipeline: sharding, filtering, deduplication, tokenisation, packing, search.

Nothing outside this package and ``corpus_pipeline.py`` imports it, so that the
rest of the library works without it.
"""
