"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pagemill.plans import markdown_queries, metrics_queries, more_queries, page_queries, scoring_queries, stream_queries, text_queries  # noqa: F401
from pagemill.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
