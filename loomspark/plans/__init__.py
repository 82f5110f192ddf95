"""Named queries over the test tables, with SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["curation", "sampling", "joining", "graphs", "ranking", "records", "labelling", "evidence", "rules", "contracts", "statements", "flow", "fills"]


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"{__name__}.{m}"), name)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracles() -> dict[str, str]:
    return _all("ORACLES")
