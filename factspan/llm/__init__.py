"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it; ``factspan.llm.catalogue`` lists its
queries for the entry module.
"""
