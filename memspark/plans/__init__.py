"""Registered queries: every operator over the driver's tables, with SQL for DuckDB."""

from . import evaluation, facts, graphs, retrieval, upkeep, writing  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
