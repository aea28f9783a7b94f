"""Queries of the subpackage by name, with SQL where SQL can say the same."""

from __future__ import annotations

from sylvaspark.llm import encoding, lookalikes, mapping, packing, responses, splitting, subjects, survivors

MODULES = [lookalikes, encoding, packing, responses, splitting, mapping, survivors, subjects]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
