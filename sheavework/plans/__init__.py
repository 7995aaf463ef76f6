"""Registered queries over the given tables, each with the SQL that states its result."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

for _name in ("documents", "grids", "nearest", "catalogs", "lookup", "intake", "chats", "console", "streams"):
    importlib.import_module(f"{__name__}.{_name}")


def all_queries() -> dict:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
