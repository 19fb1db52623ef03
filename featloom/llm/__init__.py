"""Operators of a corpus pipeline for training data. Nothing else in the library imports this package."""

from . import queries as _queries

QUERIES, ORACLES = _queries.QUERIES, _queries.ORACLES

__all__ = ["ORACLES", "QUERIES"]
