"""All registered queries."""

from __future__ import annotations

from themeloom.plans import (
    cluster_queries,
    store_queries,
    text_queries,
    theme_queries,
    vector_queries,
)

_PARTS = (text_queries, vector_queries, theme_queries, cluster_queries, store_queries)

RUN = {name: run for part in _PARTS for name, run in part.RUN.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
