"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from pagemill.llm import decontamination, html_wrappers, jaccard_join, language_id, line_dedup, pseudonyms, quality_rules, segmentation, sharding, token_counts

MODULES = (quality_rules, sharding, pseudonyms, language_id, line_dedup, segmentation, decontamination, token_counts, jaccard_join, html_wrappers)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
