"""Queries of the engine's own operators, gathered from its plan modules."""

from __future__ import annotations

from pagesieve.plans import events, files, graph, pages, streams, triage, vectors

MODULES = (pages, events, graph, vectors, streams, triage, files)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
