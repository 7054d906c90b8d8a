"""Queries of this package over the shared test tables, with SQL where SQL can say it."""
from __future__ import annotations

import importlib
import os

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under `name`."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return keep


def load():
    """Import every query module once."""
    for f in sorted(os.listdir(os.path.dirname(__file__))):
        if f.startswith("q_") and f.endswith(".py"):
            importlib.import_module(f"docsift.llm.{f[:-3]}")
    return QUERIES, ORACLES
