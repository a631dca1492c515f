"""All registered queries."""

from __future__ import annotations

from . import catalog_answers, catalog_models, catalog_stats, catalog_tables, catalog_text  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
