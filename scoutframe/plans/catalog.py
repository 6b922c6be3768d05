"""Importing this module registers every query."""

from . import aggregates, features, joins, ledger, models, portfolio, scalars, schema, sources, streams, value, windows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
