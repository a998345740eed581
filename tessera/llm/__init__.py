"""Operators for building training data: cleaning, deduplication, mixing, formatting, token output.

Nothing else in the library imports this subpackage. Queries over the given
tables are in ``queries``, their SQL in ``oracles``.
"""
