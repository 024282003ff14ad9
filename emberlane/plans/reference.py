"""Registered queries for the attention-event operators and their SQL."""

from __future__ import annotations

import importlib

from .views import Entry, Query

_MODULES = ("q_clean", "q_series", "q_joins", "q_aggregates", "q_text", "q_panel", "q_agreement", "q_survival", "q_streams")


def _entries() -> dict[str, Entry]:
    out: dict[str, Entry] = {}
    for name in _MODULES:
        out |= importlib.import_module(f"{__package__}.{name}").QUERIES
    return out


def queries() -> dict[str, Query]:
    return {name: e.run for name, e in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.sql for name, e in _entries().items() if e.sql}
