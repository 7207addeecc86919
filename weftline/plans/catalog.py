"""All queries of the core: name -> (callable, SQL or None)."""

from __future__ import annotations

from . import data_queries, judge_queries, more_queries, score_queries, text_queries

_ENTRIES: dict = {**data_queries.QUERIES, **score_queries.QUERIES, **more_queries.QUERIES, **text_queries.QUERIES, **judge_queries.QUERIES}


def queries() -> dict:
    return {k: f for k, (f, _) in _ENTRIES.items()}


def oracle_sql() -> dict:
    return {k: s for k, (_, s) in _ENTRIES.items() if s}
