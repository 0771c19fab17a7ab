"""Operators for training-data pipelines: tokenising, scoring, search, mixing, sharding and deduplication.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; the queries
registered for them are in :mod:`papyra.llm.queries`.
"""
