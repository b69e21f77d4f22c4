"""The list of registered queries, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoscope.plans.derived import with_views

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}

# Engines add floating numbers in different orders; results agree to this many decimals.
DIGITS = 6


def add(name: str, build: Build, views: str = "", sql: str | None = None, rounded: str = "") -> None:
    """Register a query. ``views`` names the input views its SQL reads; ``rounded`` the floating
    result columns, which are rounded the same way on both sides."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    columns = rounded.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = build(spark, sf_dir)
        return result.withColumns({c: F.round(c, DIGITS) for c in columns}) if columns else result

    QUERIES[name] = run
    if sql is None:
        return
    if columns:
        replaced = ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in columns)
        head, cut, tail = sql.partition("--result\n")
        ctes, final = (head, tail) if cut else ("", sql)
        sql = f"{ctes.rstrip()} SELECT * REPLACE ({replaced}) FROM ({final}) AS result"
    else:
        sql = sql.replace("--result\n", "")
    ORACLES[name] = with_views(views, sql)
