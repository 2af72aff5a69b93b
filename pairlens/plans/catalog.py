"""All registered queries."""
from __future__ import annotations

from . import q_joins, q_models, q_sources, q_stats, q_tables, q_text  # noqa: F401
from .registry import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

__all__ = ["ORACLES", "QUERIES", "TABLES"]
