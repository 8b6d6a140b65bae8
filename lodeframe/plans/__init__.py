"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from lodeframe.plans import events, findings, texts

_PARTS = (findings, texts, events)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
