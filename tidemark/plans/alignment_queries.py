"""Queries that align sources on clocks of their own with hourly origins, and what these add to a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators import alignment, candles, features, forecasts
from tidemark.plans.base import BARS, FINE, TYPED, query, table, typed
from tidemark.plans.candle_queries import FEATURES

#: The series that stands for another asset beside each.
PEERS = {"click": "error", "error": "purchase", "purchase": "signup", "signup": "view", "view": "click"}
BASE = ["volatility_6h", "volatility_24h", "volume_z", "rsi_14", "momentum_6h", "momentum_24h"]
HOUR = 3600


def _lagged(rows: DataFrame, value: str, back: int, change: str) -> DataFrame:
    before = F.lag(value, back).over(W.partitionBy("series").orderBy("ts"))
    return rows.withColumn(change, (F.col(value) / F.nullif(before, F.lit(0.0)) - 1) * 100)


def _every(events: DataFrame, width: str, value, name: str) -> DataFrame:
    """A value of each series and span of time, known at its end."""
    return events.groupBy("series", F.window("ts", width)["end"].alias("bar")).agg(value.alias(name)).withColumnRenamed("bar", "ts")


def sources(spark, sf_dir) -> dict[str, list[alignment.Source]]:
    """Sources by kind: those of the series itself, of others, and of finer bars."""
    events = table(spark, sf_dir, "events").withColumn("series", F.col("event_type"))
    funding = _lagged(_every(events, "8 hours", F.avg("value"), "rate"), "rate", 3, "change")
    activity = _lagged(_every(events, "1 hour", F.count_distinct("user_id").cast("double"), "users"), "users", 24, "change")
    turned = F.create_map(*[F.lit(x) for series, peer in PEERS.items() for x in (peer, series)])
    peer = features.market_features(typed(spark, sf_dir)).select(turned[F.col("series")].alias("series"), "ts", "momentum_24h", "volatility_24h")
    daily = _lagged(_every(events.withColumn("series", F.lit("all")), "1 day", F.avg("value"), "level"), "level", 1, "change")
    daily = daily.withColumn("series", F.explode(F.array(*[F.lit(s) for s in PEERS])))
    order = W.partitionBy("series").orderBy("ts")
    fine = features.log_returns(candles.bars(events, "5 minutes", F.col("series")))
    fine = fine.select("series", "ts", "ret", F.stddev_pop("ret").over(order.rowsBetween(-11, 0)).alias("spread"), F.avg("volume").over(order.rowsBetween(-11, 0)).alias("volume"))
    return {
        "derivatives": [alignment.Source("funding", funding, ("rate", "change"), 16 * HOUR), alignment.Source("activity", activity, ("users", "change"), 6 * HOUR)],
        "cross_asset": [alignment.Source("peer", peer, ("momentum_24h", "volatility_24h"), 3 * HOUR), alignment.Source("daily", daily, ("level", "change"), 96 * HOUR)],
        "resolution": [alignment.Source("fine", fine, ("ret", "spread", "volume"), HOUR)],
    }


TABLES = f"""{FEATURES.replace(BARS, TYPED.replace("typed AS", "bars AS"))}, {FINE}, funding AS (
  SELECT *, (rate / nullif(lag(rate, 3) OVER (PARTITION BY series ORDER BY known), 0) - 1) * 100 AS change FROM (
    SELECT event_type AS series, time_bucket(INTERVAL 8 HOUR, ts) + INTERVAL 8 HOUR AS known, avg(value) AS rate FROM events GROUP BY 1, 2)), activity AS (
  SELECT *, (users / nullif(lag(users, 24) OVER (PARTITION BY series ORDER BY known), 0) - 1) * 100 AS change FROM (
    SELECT event_type AS series, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS known, CAST(count(DISTINCT user_id) AS DOUBLE) AS users FROM events GROUP BY 1, 2)), peer AS (
  SELECT p.series, f.ts AS known, momentum_24h, volatility_24h FROM feats f JOIN (VALUES {", ".join(f"('{s}', '{p}')" for s, p in PEERS.items())}) p(series, peer) ON f.series = p.peer), daily AS (
  SELECT p.series, d.* FROM (VALUES {", ".join(f"('{s}')" for s in PEERS)}) p(series), (
    SELECT *, (level / nullif(lag(level) OVER (ORDER BY known), 0) - 1) * 100 AS change FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS known, avg(value) AS level FROM events GROUP BY 1)) d), fr AS (
  SELECT *, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close) - ln(lag(close) OVER w) END AS ret FROM fine WINDOW w AS (PARTITION BY series ORDER BY ts)), finer AS (
  SELECT series, ts AS known, ret, stddev_pop(ret) OVER w AS spread, avg(volume) OVER w AS volume FROM fr WINDOW w AS (PARTITION BY series ORDER BY ts ROWS 11 PRECEDING))"""
SPANS = {"funding": ("funding", ("rate", "change"), 16), "activity": ("activity", ("users", "change"), 6), "peer": ("peer", ("momentum_24h", "volatility_24h"), 3), "daily": ("daily", ("level", "change"), 96), "fine": ("finer", ("ret", "spread", "volume"), 1)}


def _frame_sql(*names: str) -> str:
    joins = " ".join(f"ASOF LEFT JOIN {SPANS[n][0]} {n}_ ON f.series = {n}_.series AND f.ts >= {n}_.known" for n in names)
    fresh = lambda n, c: f"CASE WHEN epoch(f.ts) - epoch({n}_.known) <= {SPANS[n][2] * HOUR} THEN {n}_.{c} END"
    columns = ", ".join(f"{fresh(n, c)} AS {n}_{'at' if c == 'known' else c}" for n in names for c in ("known", *SPANS[n][1]))
    absent = ", ".join(f"CASE WHEN {' OR '.join(f'{n}_{c} IS NULL' for c in SPANS[n][1])} THEN '{n}' END" for n in names)
    shown = ", ".join(f"{n}_at, " + ", ".join(f"round({n}_{c}, 5) AS {n}_{c}" for c in SPANS[n][1]) for n in names)
    return f"WITH {TABLES}, j AS (SELECT f.series, f.ts, {columns} FROM feats f {joins}) SELECT series, ts, {shown}, concat_ws(',', {absent}) AS missing FROM j"


def frame(spark, sf_dir, kind: str):
    """Every hourly origin with its features and the sources of a kind."""
    used = sources(spark, sf_dir)[kind]
    return alignment.completed(alignment.aligned(features.market_features(typed(spark, sf_dir)), used, "series", "ts"), BASE, used), used


def shown(spark, sf_dir, kind: str):
    rows, used = frame(spark, sf_dir, kind)
    columns = [c for s in used for c in (F.col(f"{s.name}_at"), *[F.round(n, 5).alias(n) for n in s.columns()])]
    return rows.select("series", "ts", *columns, F.array_join("missing", ",").alias("missing"))


@query(_frame_sql("funding", "activity"))
def derivatives_frame(spark, sf_dir):
    """Origins with rates of eight hours and activity of the last hour, and which are missing or stale."""
    return shown(spark, sf_dir, "derivatives")


@query(_frame_sql("peer", "daily"))
def cross_asset_frame(spark, sf_dir):
    """Origins with another series' state and yesterday's level of the whole market."""
    return shown(spark, sf_dir, "cross_asset")


@query(_frame_sql("fine"))
def resolution_frame(spark, sf_dir):
    """Origins with what bars of five minutes say of the hour before."""
    return shown(spark, sf_dir, "resolution")


def ablation(spark, sf_dir, kind: str):
    rows, used = frame(spark, sf_dir, kind)
    names = [*BASE, *[c for s in used for c in s.columns()]]
    complete = rows.where("complete")
    each = [forecasts.training_rows(complete, names, h).withColumn("horizon", F.lit(h)) for h in (2, 8)]
    report = alignment.source_report(reduce(DataFrame.unionByName, each), BASE, used)
    rounded = [F.round(c, 6).alias(c) for c in ("baseline_mae", "candidate_mae", "relative_gain", "baseline_direction", "candidate_direction")]
    return report.select("series", "horizon", "design", "pairs", *rounded, F.round("z", 3).alias("z"), "folds", "improved", "stable", "status")


@query()
def derivatives_ablation(spark, sf_dir):
    """What rates and activity add to a ridge model of the series' own features at the same origins."""
    return ablation(spark, sf_dir, "derivatives")


@query()
def cross_asset_ablation(spark, sf_dir):
    """What other series and the market add."""
    return ablation(spark, sf_dir, "cross_asset")


@query()
def resolution_ablation(spark, sf_dir):
    """What finer bars add."""
    return ablation(spark, sf_dir, "resolution")
