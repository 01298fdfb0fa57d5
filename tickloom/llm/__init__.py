"""Operators of a training-data pipeline: fingerprints, deduplication, quality, tokens, mixing.

Nothing else in the library imports this subpackage.
"""
