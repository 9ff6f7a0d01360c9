"""Registry of named queries: the Spark builder and its DuckDB oracle text.

A builder takes ``(spark, sf_dir)`` and returns a DataFrame built with the
library operators over the fixture views. The oracle is the same question
in ANSI SQL over the same views (placed in a WITH clause), or ``None`` when
SQL cannot express it (rows-only check).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .fixtures import with_fixtures

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Builder
    oracle: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None, fixtures: tuple[str, ...] = ()):
    """Register ``fn`` as query ``name`` with its oracle SQL."""

    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        sql = with_fixtures(oracle, *fixtures) if (oracle and fixtures) else oracle
        REGISTRY[name] = Entry(name, fn, sql)
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    # importing the modules fills REGISTRY
    from .queries import (  # noqa: F401
        bench_q,
        documents_q,
        inventory_q,
        profiles_q,
        proxy_q,
        scalars_q,
        sizing_q,
        sources_q,
        streams_q,
        windows_q,
    )

    return REGISTRY
