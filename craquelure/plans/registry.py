"""Query registry: name -> Spark query, and the equivalent SQL where there is one."""

from __future__ import annotations

import importlib
import importlib.util

from craquelure.plans.oracle import with_views
from craquelure.sources.views import Tables

MODULES = (
    "catalog",
    "fragments",
    "panes",
    "distributions",
    "geometry",
    "points",
    "layers",
    "similarity",
    "series",
    "residual",
    "fitting",
    "exports",
)

_QUERIES: dict = {}
_ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            _ORACLES[name] = with_views(sql)
        return fn

    return wrap


def _load():
    for module in MODULES:
        if not importlib.util.find_spec(f"craquelure.plans.{module}"):
            continue
        importlib.import_module(f"craquelure.plans.{module}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracles() -> dict:
    _load()
    return dict(_ORACLES)
