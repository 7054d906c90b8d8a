"""Every query of the engine over the shared test tables, with its SQL where SQL can say it."""
from __future__ import annotations

import importlib
import os

QUERIES: dict = {}
ORACLES: dict = {}
MODULES = sorted(f[:-3] for f in os.listdir(os.path.dirname(__file__)) if f.endswith(".py") and f not in ("__init__.py", "sqltext.py"))


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under `name`."""

    def keep(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return keep


def load():
    """Import every catalog module once."""
    for name in MODULES:
        importlib.import_module(f"catalog.{name}")

    return QUERIES, ORACLES
