"""Queries of the diagnostics engine and the SQL that they are held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("flow", "text", "evidence", "heap", "db", "ingest", "more")


def _parts():
    return [importlib.import_module(f"emberlens.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _parts() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in _parts() for name, s in m.SQL.items()}
