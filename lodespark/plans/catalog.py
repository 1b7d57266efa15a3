"""All registered queries and their SQL equivalents."""

from __future__ import annotations

from lodespark.plans import core_oracles as sql
from lodespark.plans import core_queries as core
from lodespark.plans import data_queries, notes_queries, rank_queries, search_queries, source_queries

MODULES = (data_queries, rank_queries, notes_queries, search_queries, source_queries)


def core_queries() -> dict:
    out = dict(core.QUERIES)
    for m in MODULES:
        out |= m.QUERIES
    return out


def core_oracles() -> dict:
    out = dict(sql.ORACLES)
    for m in MODULES:
        out |= m.ORACLES
    return out
