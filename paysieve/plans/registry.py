"""Query registry: one entry per operator key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paysieve.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(key: str):
    def deco(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(configure(spark), sf)
        run.__name__ = key
        QUERIES[key] = run
        return fn
    return deco
