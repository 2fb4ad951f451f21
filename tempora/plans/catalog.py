"""The table of queries: a Spark plan per name and, where SQL can state it, an oracle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.plans.bindings import SHARED_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, columns: Sequence[str], digits: int) -> DataFrame:
    """Doubles rounded for comparison, with -0.0 made 0.0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register a plan built from `Tables`; `doubles` are rounded on both sides."""
    columns = doubles.split()

    def wrap(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(plan(Tables(spark, sf_dir)), columns, digits)

        QUERIES[name] = run
        if sql is not None:
            replace = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)
            head = f"SELECT * REPLACE ({replace})" if columns else "SELECT *"
            ORACLES[name] = f"WITH {SHARED_SQL.strip()}\n{head} FROM (\n{sql.strip()}\n) result"
        return plan

    return wrap
