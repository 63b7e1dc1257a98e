"""Readers with explicit schemas: candles, raw rows, JSON documents and event lines.

Malformed rows are kept with their reason or dropped where a reader says so;
schemas are never inferred.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

CANDLES = "series string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
RAW = "ts string, open string, high string, low string, close string, volume string"
EVENTS = "domain string, status string, timestamp string"


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    """Columnar candles."""
    return spark.read.schema(CANDLES).parquet(path)


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Candle rows as text with a header; candles.audit_rows() tells why one is no candle."""
    return spark.read.schema(RAW).csv(path, header=True, mode="PERMISSIVE")


def read_macro_csv(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(day, value) of a daily series whose date column is observation_date or DATE; rows without either drop."""
    rows = spark.read.csv(path, header=True)
    names = {c.lower(): c for c in rows.columns}
    day = F.coalesce(*[F.expr(f"try_cast(`{names[c]}` AS DATE)") for c in ("observation_date", "date") if c in names])
    out = rows.select(day.alias("day"), F.expr(f"try_cast(`{value}` AS DOUBLE)").alias("value"))
    return out.where(F.col("day").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def eligible_macro(days: DataFrame, origins: DataFrame, at: str) -> DataFrame:
    """origins with the last daily value that was out: one of a day is out at the next midnight."""
    from tidemark.operators.pit import as_of

    out = days.select(F.lit(1).alias("__one"), (F.col("day") + F.expr("INTERVAL '1' DAY")).cast("timestamp_ntz").alias(at), "value")
    return as_of(origins.withColumn("__one", F.lit(1)), out, "__one", at, F.col("value")).drop("__one")


def read_candle_document(spark: SparkSession, path: str, resolution: str) -> DataFrame:
    """Rows of one resolution from JSON documents that hold a candle column an array."""
    columns = ("ts", "open", "high", "low", "close", "volume")
    arrays = ", ".join(f"{c}: array<{'bigint' if c == 'ts' else 'double'}>" for c in columns)
    docs = spark.read.schema(f"series string, {resolution} struct<{arrays}>").json(path, multiLine=True)
    rows = docs.select("series", F.inline(F.arrays_zip(*[F.col(f"{resolution}.{c}").alias(c) for c in columns])))
    return rows.withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz"))


def read_event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Operational events, one JSON a line; malformed lines and unreadable times drop."""
    rows = spark.read.text(path).select(F.from_json("value", EVENTS).alias("e")).where("e IS NOT NULL").select("e.*")
    return rows.withColumn("at", F.expr("try_cast(timestamp AS TIMESTAMP)")).where("at IS NOT NULL AND domain IS NOT NULL").drop("timestamp")


def read_actuals(spark: SparkSession, path: str) -> DataFrame:
    """(ts, price) from JSON documents that map epoch seconds to prices."""
    docs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, double>")).alias("k", "price"))
    return docs.select(F.timestamp_seconds(F.expr("try_cast(k AS BIGINT)")).cast("timestamp_ntz").alias("ts"), "price").where("ts IS NOT NULL AND price IS NOT NULL")


def epoch_to_ts(column: str):
    """Epoch seconds or milliseconds, told apart by size."""
    n = F.col(column).cast("double")
    return F.timestamp_millis(F.when(n > 1e10, n).otherwise(n * 1000).cast("long")).cast("timestamp_ntz")


def decoded(rows: DataFrame, column: str, schema: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """rows with state (the JSON column by the schema), defect, and drift, the keys that the schema doesn't know.

    defect is null for a usable row, else absent (null or blank), corrupt (no
    JSON object), mistyped (a known field of another type) or missing (a
    required field that isn't there or is null); states of defective rows are
    null, so nothing half read goes on. Fields may be added at any time: they
    show in drift and are no defect.
    """
    text = F.col(column)
    whole = T.StructType([*schema.fields, T.StructField("__corrupt", T.StringType())])
    out = rows.withColumns({"__keys": F.json_object_keys(text), "__state": F.from_json(text, whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})})
    lacking = reduce(lambda acc, c: acc | F.col(f"__state.{c}").isNull(), required, F.lit(False))
    defect = (
        F.when(text.isNull() | (F.trim(text) == ""), "absent").when(F.col("__keys").isNull() | F.col("__state").isNull(), "corrupt")
        .when(F.col("__state.__corrupt").isNotNull(), "mistyped").when(lacking, "missing")
    )
    out = out.withColumn("defect", defect)
    state = F.when(F.col("defect").isNull(), F.struct(*[F.col(f"__state.{f.name}").alias(f.name) for f in schema.fields]))
    drift = F.array_sort(F.array_except(F.coalesce("__keys", F.array().cast("array<string>")), F.array(*[F.lit(f.name) for f in schema.fields])))
    return out.withColumns({"state": state, "drift": drift}).drop("__keys", "__state")


def newest_states(rows: DataFrame, column: str, schema: T.StructType, key: str, at: str, keep: int, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(usable, set aside): the newest `keep` usable states of each key, and all defective rows with their defect."""
    both = decoded(rows, column, schema, required)
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))
    usable = both.where("defect IS NULL").withColumn("__nth", nth).where(F.col("__nth") <= keep).drop("__nth", "defect")
    return usable, both.where("defect IS NOT NULL").drop("state")
