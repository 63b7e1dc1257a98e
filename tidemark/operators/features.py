"""Time-series features, regimes and their transitions, causal by construction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _order() -> W:
    return W.partitionBy("series").orderBy("ts")


def log_returns(candles: DataFrame) -> DataFrame:
    """candles with ret, the difference of logarithms of consecutive positive closes."""
    log = F.when(F.col("close") > 0, F.log("close"))
    return candles.withColumn("log_close", log).withColumn("ret", F.col("log_close") - F.lag("log_close").over(_order())).drop("log_close")


def _last(n: int) -> W:
    return _order().rowsBetween(-(n - 1), 0)


def momentum(hours: int) -> Column:
    """Percent change over so many rows; 0 where there are too few."""
    before = F.lag("close", hours).over(_order())
    return F.coalesce((F.col("close") / F.nullif(before, F.lit(0.0)) - 1) * 100, F.lit(0.0))


def market_features(candles: DataFrame) -> DataFrame:
    """Volatility, range, volume, strength, momentum and time of day of every candle from itself and those before."""
    moved = log_returns(candles).withColumns(
        {
            "change": F.col("close") - F.lag("close").over(_order()),
            "range_pct": (F.col("high") - F.col("low")) / F.nullif(F.col("close"), F.lit(0.0)) * 100,
            "log_volume": F.log1p(F.greatest(F.col("volume").cast("double"), F.lit(0.0))),
            "seen": F.row_number().over(_order()),
        }
    )
    vol = {f"volatility_{k}h": F.coalesce(F.stddev_samp("ret").over(_last(k)) * 100, F.lit(0.0)) for k in (6, 24, 168)}
    gain, loss = (F.avg(F.greatest(s * F.col("change"), F.lit(0.0))).over(_last(14)) for s in (1, -1))
    spread = F.stddev_pop("log_volume").over(_last(168))
    z = F.when(spread > 1e-12, (F.col("log_volume") - F.avg("log_volume").over(_last(168))) / spread).otherwise(0.0)
    strength = (
        F.when(F.col("seen") <= 14, 50.0)
        .when(F.col("loss14") <= 0, F.when(F.col("gain14") > 0, 100.0).otherwise(50.0))
        .otherwise(100.0 - 100.0 / (1.0 + F.col("gain14") / F.nullif(F.col("loss14"), F.lit(0.0))))
    )
    hour = F.hour("ts") * (2 * math.pi / 24)
    day = F.weekday("ts") * (2 * math.pi / 7)
    found = moved.withColumns(vol | {"gain14": gain, "loss14": loss, "mean_range_24h": F.avg("range_pct").over(_last(24)), "volume_z": z})
    found = found.withColumns({"rsi_14": strength, **{f"momentum_{k}h": momentum(k) for k in (6, 24, 168)}})
    found = found.withColumns({"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "weekday_sin": F.sin(day), "weekday_cos": F.cos(day)})
    return found.drop("change", "range_pct", "log_volume", "seen", "gain14", "loss14")


def heuristic_regime() -> Column:
    """high_volatility, trending or range from market_features()."""
    trend = F.greatest(F.lit(1.0), F.col("volatility_24h") * math.sqrt(24) * 1.2)
    return (
        F.when(F.col("volatility_24h") > 1.35 * F.col("volatility_168h"), "high_volatility")
        .when((F.abs(F.col("momentum_24h")) > trend) | (F.col("rsi_14") >= 70) | (F.col("rsi_14") <= 30), "trending")
        .otherwise("range")
    )


def volatility_bucket(volatility: Column, low: float = 0.75, high: float = 1.5) -> Column:
    from tidemark.functions.scalars import bucket

    return bucket(volatility, low, high)


def confirmed_labels(labels: DataFrame, confirmations: int = 2) -> DataFrame:
    """labels (series, ts, label) with confirmed, which follows a new label once it came so often in a row.

    The n-th row of a run of equal labels confirms it at n = confirmations; the
    first row of a series is confirmed at once. The confirmed label is the last
    one that a run confirmed, so windows are enough and no state is kept.
    """
    changed = F.coalesce((F.col("label") != F.lag("label").over(_order())).cast("int"), F.lit(0))
    runs = labels.withColumn("changed", changed).withColumn("run", F.sum("changed").over(_order()))
    nth = F.row_number().over(W.partitionBy("series", "run").orderBy("ts"))
    first = F.row_number().over(_order()) == 1
    marked = runs.withColumn("nth", nth).withColumn("sure", F.when((F.col("nth") >= confirmations) | first, F.col("label")))
    return marked.withColumn("confirmed", F.last("sure", ignorenulls=True).over(_order())).drop("changed", "run", "nth", "sure")


def churn(labels: DataFrame, label: str = "label") -> DataFrame:
    """Rows, transitions and their share of each series."""
    moved = labels.withColumn("moved", (F.col(label) != F.lag(label).over(_order())).cast("long"))
    out = moved.groupBy("series").agg(F.count("*").alias("rows"), F.coalesce(F.sum("moved"), F.lit(0)).alias("transitions"))
    return out.withColumn("churn", F.coalesce(F.col("transitions") / F.nullif(F.col("rows") - 1, F.lit(0)), F.lit(0.0)))
