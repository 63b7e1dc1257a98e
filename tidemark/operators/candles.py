"""Candles: bars from events, their validation, gaps, overlaps and repairs.

Candles are rows (series, ts, open, high, low, close, volume); ts is the time at
which a bar closes. Every ordered window is partitioned by series.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F


@dataclass(frozen=True)
class GapPolicy:
    """Limits of comparing providers and of filling gaps."""

    interval_seconds: int = 3600
    last_common: int = 24
    least_common: int = 6
    tolerance_pct: float = 0.75
    max_missing: int = 3
    degrade_missing: int = 1


def seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def bars(events: DataFrame, every: str = "1 hour", series: Column | None = None, ts: str = "ts", value: str = "value", event: str = "event_id") -> DataFrame:
    """Open, high, low, close and number of each tumbling window, stamped with its end."""
    keyed = events.select((F.lit("all") if series is None else series).alias("series"), F.window(F.col(ts), every)["end"].alias("bar"), ts, value, event)
    order = F.struct(ts, event)
    grouped = keyed.groupBy("series", F.col("bar").alias("close_at"))
    out = grouped.agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").alias("volume")
    )
    return out.withColumnRenamed("close_at", "ts")


def newest(candles: DataFrame, now: Column, limit: int) -> DataFrame:
    """Closed candles only, and the last `limit` of each series."""
    rank = F.row_number().over(W.partitionBy("series").orderBy(F.desc("ts")))
    return candles.where(F.col("ts") <= now).withColumn("age_rank", rank).where(F.col("age_rank") <= limit).drop("age_rank")


def strict_bars(candles: DataFrame, parts: int, every: str) -> DataFrame:
    """Bars of a coarser width from finer ones, only where all `parts` are there; close-stamped."""
    opened = F.window(F.col("ts") - F.expr("INTERVAL 1 MICROSECOND"), every)["end"]
    grouped = candles.withColumn("bar", opened).groupBy("series", "bar").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("parts"),
    )
    return grouped.where(F.col("parts") == parts).drop("parts").withColumnRenamed("bar", "ts")


def stride_downsample(candles: DataFrame, every: int) -> DataFrame:
    """Every so many-th candle counted back from the newest."""
    rank = F.row_number().over(W.partitionBy("series").orderBy(F.desc("ts")))
    return candles.withColumn("back", rank - 1).where(F.col("back") % every == 0).drop("back")


def missing_runs(candles: DataFrame, policy: GapPolicy = GapPolicy()) -> DataFrame:
    """Runs of missing lattice points: first and last missing time and their number."""
    width = policy.interval_seconds
    before = F.lag("ts").over(W.partitionBy("series").orderBy("ts"))
    gaps = candles.select("series", "ts", before.alias("before")).withColumn("step", seconds(F.col("ts")) - seconds(F.col("before"))).where(F.col("step") > width)
    missing = F.ceil(F.col("step") / width).cast("long") - 1
    each = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(width))
    last = F.col("before") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), missing * width)
    return gaps.select("series", (F.col("before") + each).alias("first_missing"), last.alias("last_missing"), missing.alias("missing"))


def overlap(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Closes that both have, with the difference in percent of their midpoint."""
    right = secondary.select("series", "ts", F.col("close").alias("other_close"))
    diff = F.abs(F.col("close") - F.col("other_close")) / F.nullif((F.col("close") + F.col("other_close")) / 2, F.lit(0.0)) * 100
    return primary.select("series", "ts", "close").join(right, ["series", "ts"]).withColumn("diff_pct", diff)


def overlap_report(primary: DataFrame, secondary: DataFrame, policy: GapPolicy = GapPolicy()) -> DataFrame:
    """Mean and largest difference over the last common candles of each series, and whether they agree."""
    rank = F.row_number().over(W.partitionBy("series").orderBy(F.desc("ts")))
    last = overlap(primary, secondary).withColumn("back", rank).where(F.col("back") <= policy.last_common)
    out = last.groupBy("series").agg(
        F.count("*").alias("common"), F.avg("diff_pct").alias("mean_diff_pct"), F.max("diff_pct").alias("max_diff_pct"),
        F.count_if(F.col("diff_pct") > policy.tolerance_pct).alias("divergent"),
    )
    status = F.when(F.col("common") < policy.least_common, "insufficient").when(F.col("max_diff_pct") > policy.tolerance_pct, "divergent").otherwise("agree")
    return out.withColumn("status", status)


def silent_fills(primary: DataFrame, secondary: DataFrame, policy: GapPolicy = GapPolicy()) -> DataFrame:
    """Candles of a secondary that stand where the primary has none, and those of either off the lattice."""
    on = seconds(F.col("ts")) % policy.interval_seconds == 0
    filled = secondary.select("series", "ts").where(on).join(primary.select("series", "ts"), ["series", "ts"], "left_anti")
    edges = primary.groupBy("series").agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    filled = filled.join(edges, "series").where("ts > low AND ts < high").select("series", "ts", F.lit("filled_by_secondary").alias("kind"))
    off = primary.select("series", "ts").union(secondary.select("series", "ts")).where(~on).distinct()
    return filled.unionByName(off.select("series", "ts", F.lit("off_lattice").alias("kind")))


def gap_decisions(primary: DataFrame, secondary: DataFrame, policy: GapPolicy = GapPolicy()) -> DataFrame:
    """fill, degrade or withhold for each missing run: by its length, coverage and the providers' agreement."""
    runs = missing_runs(primary, policy)
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(policy.interval_seconds))
    points = runs.select("*", F.explode(F.sequence("first_missing", "last_missing", step)).alias("ts"))
    found = secondary.select("series", "ts", F.lit(1).alias("there"))
    covered = points.join(found, ["series", "ts"], "left").groupBy("series", "first_missing", "last_missing", "missing").agg(F.count("there").alias("covered"))
    agreed = overlap_report(primary, secondary, policy).select("series", "status")
    whole = F.col("covered") == F.col("missing")
    action = (
        F.when(F.col("missing") > policy.max_missing, "withhold")
        .when(whole & (F.col("status") == "agree"), "fill")
        .when(whole, "degrade")
        .when(F.col("missing") <= policy.degrade_missing, "degrade")
        .otherwise("withhold")
    )
    return covered.join(agreed, "series", "left").withColumn("action", action)


def run_action(decisions: DataFrame) -> DataFrame:
    """The severest action of each series, and how often each was decided."""
    rank = F.when(F.col("action") == "withhold", 3).when(F.col("action") == "degrade", 2).otherwise(1)
    counts = [F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("withhold", "degrade", "fill")]
    return decisions.groupBy("series").agg(F.max_by("action", rank).alias("action"), *counts)


def backfill(primary: DataFrame, secondary: DataFrame, policy: GapPolicy = GapPolicy()) -> DataFrame:
    """The primary with the gaps that are to be filled taken from the secondary; provenance says from where."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(policy.interval_seconds))
    fill = gap_decisions(primary, secondary, policy).where("action = 'fill'").select("series", F.explode(F.sequence("first_missing", "last_missing", step)).alias("ts"))
    columns = ["series", "ts", "open", "high", "low", "close", "volume"]
    added = secondary.join(fill, ["series", "ts"], "left_semi").select(*columns, F.lit("secondary").alias("provenance"))
    return primary.select(*columns, F.lit("primary").alias("provenance")).unionByName(added)


def middle(ordered: Column) -> Column:
    """The median of a sorted array; null if it is empty."""
    n = F.size(ordered)
    at = lambda k: F.try_element_at(ordered, k.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def validate(candles: DataFrame, now: Column, interval_seconds: int = 3600, stale_seconds: int = 7200, window: int = 168, volume_ratio: float = 20.0) -> DataFrame:
    """(series, code, rows): how many candles break each rule."""
    order = W.partitionBy("series").orderBy("ts")
    step = seconds(F.col("ts")) - seconds(F.lag("ts").over(order))
    usual = middle(F.sort_array(F.collect_list(F.col("volume").cast("double")).over(order.rowsBetween(-window, -1))))
    jump = F.abs(F.col("close") / F.nullif(F.lag("close").over(order), F.lit(0.0)) - 1)
    price = ["open", "high", "low", "close"]
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    rules = {
        "non_finite_price": bad("open") | bad("high") | bad("low") | bad("close"),
        "non_positive_price": F.least(*price) <= 0,
        "negative_volume": F.col("volume") < 0,
        "high_below_body": F.col("high") < F.greatest("open", "close", "low"),
        "low_above_body": F.col("low") > F.least("open", "close", "high"),
        "duplicate_timestamp": F.col("step") == 0,
        "missing_interval": F.col("step") > interval_seconds,
        "misaligned_interval": F.col("step") % interval_seconds != 0,
        "off_lattice": seconds(F.col("ts")) % interval_seconds != 0,
        "future_candle": F.col("ts") > now,
        "extreme_volume": F.col("volume") > volume_ratio * F.col("usual"),
        "price_jump": F.col("jump") > 0.5,
    }
    marked = candles.withColumns({"step": step, "usual": usual, "jump": jump})
    codes = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()]))
    found = marked.select("series", F.explode(codes).alias("code")).groupBy("series", "code").agg(F.count("*").alias("rows"))
    stale = candles.groupBy("series").agg(F.max("ts").alias("last")).where(seconds(now) - seconds(F.col("last")) > stale_seconds)
    return found.unionByName(stale.select("series", F.lit("stale").alias("code"), F.lit(1).cast("long").alias("rows")))


@dataclass(frozen=True)
class QualityLimits:
    """What a series of candles must keep to."""

    interval_seconds: int = 3600
    least_candles: int = 64
    stale_minutes: float = 90.0
    future_seconds: int = 60
    return_pct: float = 20.0
    range_pct: float = 30.0
    volume_ratio: float = 50.0
    lookback: int = 168
    least_history: int = 24


def quality_report(candles: DataFrame, now: Column, limits: QualityLimits = QualityLimits(), arrival: str = "ts") -> DataFrame:
    """(series, code, rows): every rule that a series breaks, and how many candles do.

    arrival: a column in whose order candles came, so that late ones show.
    Relations of prices are judged where all prices of the series are finite,
    returns where all closes are positive besides, ranges where all lows are,
    and volumes where all volumes are. A series without errors has no row.
    """
    group, order = W.partitionBy("series"), W.partitionBy("series").orderBy(arrival, "ts")
    every = lambda c: F.min(F.coalesce(c, F.lit(False)).cast("int")).over(group) == 1
    finite = lambda c: F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    prices = ["open", "high", "low", "close"]
    step = seconds(F.col("ts")) - seconds(F.lag("ts").over(order))
    past = order.rowsBetween(-limits.lookback, -1)
    usual = middle(F.sort_array(F.collect_list(F.col("volume").cast("double")).over(past)))  # of `lookback` values at most
    marked = candles.withColumns(
        {
            "__step": step, "__usual": usual, "__seen": F.row_number().over(order), "__before": F.lag("close").over(order), "__n": F.count("*").over(group), "__last": F.last("ts").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
            "__finite": every(finite("open") & finite("high") & finite("low") & finite("close")), "__closes": every(F.col("close") > 0), "__lows": every(F.col("low") > 0), "__volumes": every(finite("volume") & (F.col("volume") > 0)),
        }
    )
    age = seconds(now) - seconds(F.col("__last"))
    first = F.col("__seen") == 1
    bounded = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high"))
    rules = {
        "insufficient_candles": first & (F.col("__n") < limits.least_candles), "invalid_timestamp": seconds(F.col("ts")) <= 0,
        **{f"non_finite_{c}": ~finite(c) for c in [*prices, "volume"]}, **{f"non_positive_{c}": F.col(c) <= 0 for c in [*prices, "volume"]},
        "invalid_ohlc": F.col("__finite") & ~bounded,
        "extreme_hourly_return": F.col("__finite") & F.col("__closes") & (F.abs(F.col("close") / F.col("__before") - 1) * 100 > limits.return_pct),
        "extreme_candle_range": F.col("__finite") & F.col("__lows") & ((F.col("high") / F.nullif(F.col("low"), F.lit(0.0)) - 1) * 100 > limits.range_pct),
        "extreme_volume": F.col("__volumes") & (F.col("__seen") > limits.least_history) & (F.col("volume") / F.nullif(F.col("__usual"), F.lit(0.0)) > limits.volume_ratio),
        "duplicate_timestamp": F.col("__step") == 0, "out_of_order_timestamp": F.col("__step") < 0,
        "missing_or_irregular_candle": (F.col("__step") > 0) & (F.col("__step") != limits.interval_seconds),
        "future_timestamp": first & (age < -limits.future_seconds), "stale_data": first & (age > limits.stale_minutes * 60),
    }
    codes = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()]))
    return marked.select("series", F.explode(codes).alias("code")).groupBy("series", "code").agg(F.count("*").alias("rows"))


def winsorise_volume(candles: DataFrame, window: int = 168, multiplier: float = 20.0) -> DataFrame:
    """Volumes capped at a multiple of the median of the last `window` capped ones.

    A cap depends on caps before it, so each series is read in order; one whose
    candles exceed a task's memory is to be cut into overlapping periods first.
    """

    def cap(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ts", kind="stable")
        volume = part["volume"].to_numpy(float).copy()
        for k in range(1, len(volume)):
            usual = float(np.median(volume[max(0, k - window) : k]))
            if usual > 0 and volume[k] > multiplier * usual:
                volume[k] = multiplier * usual
        return part.assign(capped_volume=volume)

    return candles.groupBy("series").applyInPandas(cap, f"{_ddl(candles)}, capped_volume double")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def audit_rows(rows: DataFrame) -> DataFrame:
    """Rows of raw text columns with the reasons for which each can't be a candle."""
    number = {c: F.expr(f"try_cast({c} AS DOUBLE)") for c in ("open", "high", "low", "close", "volume")}
    reasons = [F.when(v.isNull(), f"{c}_unparsable") for c, v in number.items()]
    reasons.append(F.when(F.expr("try_cast(ts AS TIMESTAMP_NTZ)").isNull(), "ts_unparsable"))
    reasons.append(F.when(number["high"] < number["low"], "high_below_low"))
    reasons.append(F.when(F.least(number["open"], number["close"], number["low"]) <= 0, "non_positive"))
    return rows.withColumn("reasons", F.array_compact(F.array(*reasons)))
