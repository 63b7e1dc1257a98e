"""Tables that the registered queries share, in Spark and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators import candles

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its name, with its SQL if SQL can say it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals, so that the order of a sum doesn't show."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of all events."""
    return candles.bars(table(spark, sf_dir, "events"))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type, which have gaps."""
    return candles.bars(table(spark, sf_dir, "events"), series=F.col("event_type"))


def thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type without a third of the users: a provider with more gaps."""
    return candles.bars(table(spark, sf_dir, "events").where("user_id % 3 <> 0"), series=F.col("event_type"))


def _bars(name: str, series: str, where: str = "TRUE", width: str = "1 hour") -> str:
    return f"""{name} AS (
  SELECT {series} AS series, time_bucket(INTERVAL '{width}', ts) + INTERVAL '{width}' AS ts,
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume
  FROM events WHERE {where} GROUP BY 1, 2)"""


BARS = _bars("bars", "'all'")
TYPED = _bars("typed", "event_type")
THINNED = _bars("thinned", "event_type", "user_id % 3 <> 0")
FINE = _bars("fine", "event_type", width="5 minutes")
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
