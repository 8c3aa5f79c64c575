"""Operators of a training-data pipeline: packing, near-duplicates, sharding, scoring, sanitising and output.

Nothing outside this subpackage imports it. Every operator is a function from DataFrames to a DataFrame; the thin
queries over the given tables are in :mod:`cnvspark.llm.queries`.
"""
