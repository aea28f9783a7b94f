"""Every query of the core by name, with its SQL."""

from __future__ import annotations

from sylvaspark.operators import answers, doctree, fields, graphs, handlers, hierarchy, lexical, linking, metrics, programs, refresh, vectors

MODULES = [hierarchy, lexical, fields, linking, vectors, graphs, programs, doctree, metrics, refresh, answers, handlers]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
