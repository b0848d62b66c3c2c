"""All registered queries of the geometry library and their DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = re.sub(r"\bby\b", '"by"', sql)  # the y of corner b is a reserved word
        return f

    return add


def _load() -> None:
    from . import aggregate_queries, crossing_queries, curvature_queries, extent_queries, field_queries, file_queries, join_queries, mesh_queries, normal_queries, refine_queries, scalar_queries, sequence_queries, shape_queries, surface_queries, table_queries, terrain_queries, transform_queries  # noqa: F401


_load()
