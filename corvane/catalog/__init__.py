"""Registered queries: each operator of the inventory on the driver's tables, beside equivalent SQL."""

from __future__ import annotations

from . import candidates, checks, conditioning, geometry, lengths, letters, tracks, validation  # noqa: F401  (they register their queries)
from .roles import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
