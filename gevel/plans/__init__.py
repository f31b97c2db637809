"""Named queries: each takes the session and a folder of tables and returns a lazily built DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gevel.plans import batches, cards, feed, ingest, lookups, maps, mirrors, pages, properties, requests, resolutions, social, standings, texts, valuation, writes

_MODULES = (feed, valuation, properties, pages, maps, social, ingest, batches, mirrors, writes, texts, requests, resolutions, lookups, standings, cards)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
