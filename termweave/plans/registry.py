"""The registered queries: a Spark plan each, with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(sql: str | None, *covers: str) -> Callable[[Build], Build]:
    """Register a function under its name, with its SQL and the inventory rows it covers."""

    def add(build: Build) -> Build:
        REGISTRY[build.__name__] = Query(build.__name__, build, sql, covers)
        return build

    return add


def load_all() -> dict[str, Query]:
    """All queries, after importing the modules that register them."""
    from termweave.plans import expressions, fragments, histories, joins, loads, texts  # noqa: F401

    return REGISTRY
