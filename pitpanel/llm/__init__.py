"""Operators for preparing training data: cleaning, deduplication, scoring, mixing, sharding.

Nothing else in the library imports this subpackage.
"""
