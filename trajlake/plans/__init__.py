"""Registered queries over the standard tables and the SQL that each must equal."""

from __future__ import annotations

from importlib import import_module

_MODULES: list[str] = ["groups_q", "text_q", "tokens_q", "events_q", "cards_q", "rubrics_q", "rollouts_q", "search_q", "flow_q", "documents_q", "streams_q", "masks_q", "training_q"]


def _collect(what: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        found = getattr(import_module(f"{__name__}.{name}"), what)
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"queries registered twice: {sorted(clash)}")
        out |= found
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("SQL")
