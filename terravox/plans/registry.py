"""Registered queries: a Spark job, its column types, and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravox.sources.tables import every_site, every_site_sql

_TYPES = {"b": "bigint", "d": "double", "s": "string", "t": "boolean"}
_SQL_TYPES = {"b": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "t": "BOOLEAN"}


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    survey: str


QUERIES: dict[str, Query] = {}


def query(name: str, cols: str, survey: str, sql: str | None = None, every: str | None = None):
    """Register ``fn(spark, sf_dir)``.

    ``every`` names a population (``hotspot``, ``null``, or ``kind`` for the one in the row) whose results
    were made once per position: all its sites get their rows, in both engines.

    ``cols`` lists ``column:type`` with type b (bigint), d (double, reported to 6 decimals),
    s (string) or t (boolean); both engines are projected onto it.
    """
    spec = [c.strip().split(":") for c in cols.split(",")]

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            if every:
                out = every_site(spark, sf_dir, out, every)
            return out.select(
                *[
                    (F.round(F.col(c).cast("double"), 6) + F.lit(0.0) if t == "d" else F.col(c).cast(_TYPES[t])).alias(c)
                    for c, t in spec
                ]
            )

        text = None
        if sql is not None:
            items = ", ".join(
                f'round(CAST("{c}" AS DOUBLE), 6) + 0.0 AS "{c}"' if t == "d" else f'CAST("{c}" AS {_SQL_TYPES[t]}) AS "{c}"'
                for c, t in spec
            )
            inner = every_site_sql(sql.strip(), every) if every else sql.strip()
            text = f"SELECT {items} FROM (\n{inner}\n) AS q"
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, run, text, survey)
        return fn

    return wrap
