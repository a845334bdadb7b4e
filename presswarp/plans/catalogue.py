"""All queries of the library over the driver's tables, with their SQL."""

from __future__ import annotations

from . import archives, choices, consensus, editorial, entities, evidence, heat, intake, markup, monitor, ops, pool, reading, relational, stories, streams, surfaces, text  # noqa: F401  they enter their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
