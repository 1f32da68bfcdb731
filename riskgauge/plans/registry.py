"""All registered queries of the engine."""

from __future__ import annotations

from . import group_queries, other_queries, prep_queries, risk_queries


def entries() -> dict:
    out = {}
    for m in (risk_queries, group_queries, prep_queries, other_queries):
        out |= m.entries()
    return out
