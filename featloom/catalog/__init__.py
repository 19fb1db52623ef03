"""All registered queries, and the SQL they are checked against."""

from . import curves, distributions, featuresets, masked, models, reshape  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
