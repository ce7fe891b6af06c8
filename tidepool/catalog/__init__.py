"""The registered queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ["ingest", "summaries", "offline", "decaying", "mapping", "runs"]


def registries():
    return [import_module(f"tidepool.catalog.{m}").registry for m in MODULES]


def all_queries() -> dict:
    return {name: fn for r in registries() for name, fn in r.queries.items()}


def all_sql() -> dict:
    return {name: sql.strip() for r in registries() for name, sql in r.sql.items()}
