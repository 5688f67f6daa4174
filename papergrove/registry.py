"""All registered queries of the library, and their SQL."""

from __future__ import annotations

from papergrove.plans.queries import QUERIES
from papergrove.plans.sql import SQL

__all__ = ["QUERIES", "SQL"]
