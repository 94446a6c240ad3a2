"""Operators of a training-data pipeline: tokenising, deduplication, scans, sharding, packing.

Nothing else in the library imports this subpackage.  Shared rules of all operators:
they read only the id and the text (or vector) column they are told to read, so extra
columns never clash with what they add; null text counts as empty text; empty tables give
empty results with the same schema.
"""
