"""Registered queries of the engine and their SQL, over whole tables."""

from .queries import QUERIES
from .sql import ORACLES

__all__ = ["ORACLES", "QUERIES"]
