"""Queries on drift and its events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import drift
from tidemark.plans.base import query, r6
from tidemark.plans.candle_queries import FEATURES, NAMES, regimes
from tidemark.plans.forecast_queries import SCORED, scored


def windows_sql(rows: str, by: str, recent: int, before: int, p: str = "") -> str:
    """Medians, shift and distance of the newest rows of x(by, k, v), k counting back from 1; p opens the names of its steps."""
    return f"""
{p}x AS ({rows}), {p}sized AS (SELECT {by} FROM {p}x GROUP BY {by} HAVING count(*) = {recent + before}),
{p}m AS (SELECT {by}, median(v) FILTER (k > {recent}) AS mb, median(v) FILTER (k <= {recent}) AS mr FROM {p}x JOIN {p}sized USING ({by}) GROUP BY {by}),
{p}d AS (SELECT {by}, median(abs(v - mb)) FILTER (k > {recent}) AS mad FROM {p}x JOIN {p}m USING ({by}) GROUP BY {by}),
{p}c AS (SELECT {by}, v, sum(CAST(k <= {recent} AS INT)) OVER w / {recent} AS fr, sum(CAST(k > {recent} AS INT)) OVER w / {before} AS fb
  FROM {p}x JOIN {p}sized USING ({by}) WINDOW w AS (PARTITION BY {by} ORDER BY v RANGE UNBOUNDED PRECEDING)),
{p}s AS (SELECT {by}, max(abs(fr - fb)) AS ks FROM {p}c GROUP BY {by}),
{p}z AS (SELECT {by}, mb, mr, round(abs(mr - mb) / greatest(1.4826 * mad, 0.1 * abs(mb), 1e-6), 6) AS shift, round(ks, 6) AS ks
  FROM {p}m JOIN {p}d USING ({by}) JOIN {p}s USING ({by})),
{p}g AS (SELECT *, CASE WHEN shift >= 3.5 OR ks >= 0.55 THEN 2 WHEN shift >= 2 OR ks >= 0.35 THEN 1 ELSE 0 END AS grade FROM {p}z)"""


SAID = "CASE {g} WHEN 2 THEN 'severe' WHEN 1 THEN 'warning' ELSE 'none' END"
ERROR_ROWS = """SELECT model, horizon, errors, k, v FROM (SELECT model, horizon, row_number() OVER (PARTITION BY model, horizon ORDER BY target_at DESC) AS k, abs_pct AS abs, signed_pct AS signed
  FROM scored WHERE abs_pct IS NOT NULL AND signed_pct IS NOT NULL) UNPIVOT (v FOR errors IN (abs, signed)) WHERE k <= 32"""
ERRORS = f"""{windows_sql(ERROR_ROWS, "model, horizon, errors", 8, 24)},
hit AS (SELECT model, horizon, greatest(coalesce(avg(direction_correct) FILTER (k > 8) - avg(direction_correct) FILTER (k <= 8), 0), 0) AS dd FROM (
  SELECT *, row_number() OVER (PARTITION BY model, horizon ORDER BY target_at DESC) AS k FROM scored WHERE abs_pct IS NOT NULL AND signed_pct IS NOT NULL) WHERE k <= 32 GROUP BY 1, 2),
drifts AS (SELECT model, horizon, max(mb) FILTER (errors = 'abs') AS mb, max(mr) FILTER (errors = 'abs') AS mr, max(shift) FILTER (errors = 'abs') AS s1, max(shift) FILTER (errors = 'signed') AS s2,
  max(ks) FILTER (errors = 'abs') AS k1, max(ks) FILTER (errors = 'signed') AS k2, max(dd) AS dd, greatest(max(grade), CASE WHEN max(dd) >= 0.25 THEN 2 WHEN max(dd) >= 0.15 THEN 1 ELSE 0 END) AS worst
  FROM g JOIN hit USING (model, horizon) GROUP BY 1, 2)"""
FEATURE_ROWS = f"""SELECT feature, k, v FROM (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY ts DESC) AS k
  FROM (SELECT ts, {', '.join(NAMES)} FROM feats) UNPIVOT (v FOR feature IN ({', '.join(NAMES)})) WHERE isfinite(v)) WHERE k <= 48"""


@query(f"""WITH {SCORED}, {ERRORS} SELECT model, horizon, round(mb, 5) AS median_before, round(mr, 5) AS median_recent, round(s1, 4) AS abs_shift, round(s2, 4) AS signed_shift,
k1 AS abs_ks, k2 AS signed_ks, round(dd, 6) AS direction_drop, {SAID.format(g="worst")} AS severity FROM drifts""")
def error_drift(spark, sf_dir):
    """Shifts of absolute and signed errors and lost direction, by model and horizon."""
    out = drift.error_drift(scored(spark, sf_dir), 8, 24, drift.Thresholds(), "model", "horizon")
    shown = {"median_before": F.round("abs_median_before", 5), "median_recent": F.round("abs_median_recent", 5), "direction_drop": r6("direction_drop")}
    shown |= {f"{k}_shift": F.round(f"{k}_shift", 4) for k in ("abs", "signed")}
    return out.select("model", "horizon", *[c.alias(n) for n, c in shown.items()], "abs_ks", "signed_ks", "severity")


@query(f"""WITH {FEATURES}, {windows_sql(FEATURE_ROWS, "feature", 12, 36)}
SELECT feature, round(mb, 5) AS median_before, round(mr, 5) AS median_recent, round(shift, 4) AS shift, ks, {SAID.format(g="grade")} AS severity FROM g""")
def feature_drift(spark, sf_dir):
    """Shifts of the market features between their last 12 and the 36 values before."""
    out = drift.feature_drift(regimes(spark, sf_dir), NAMES)
    return out.select("feature", F.round("median_before", 5).alias("median_before"), F.round("median_recent", 5).alias("median_recent"), F.round("shift", 4).alias("shift"), "ks", "severity")


def events(spark, sf_dir):
    """Everything that drifts at the newest origin, and of it what an earlier run has stored: the severe features."""
    rows = scored(spark, sf_dir)
    errors = drift.error_drift(rows, 8, 24, drift.Thresholds(), "model", "horizon").select(
        F.concat_ws(":", F.lit("error"), "model", F.concat("horizon", F.lit("h"))).alias("signal_key"), F.lit("model_error").alias("kind"), "severity"
    )
    moved = drift.feature_drift(regimes(spark, sf_dir), NAMES).select(F.concat(F.lit("feature:"), "feature").alias("signal_key"), F.lit("market_feature").alias("kind"), "severity")
    newest = rows.agg(F.max("origin_at").alias("origin_at"))  # one row
    signals = errors.unionByName(moved).join(F.broadcast(newest))
    stored = signals.where("kind = 'market_feature' AND severity = 'severe'").select("origin_at", "signal_key", "severity")
    return drift.drift_events(signals, stored)


EVENTS = f"""{ERRORS}, {windows_sql(FEATURE_ROWS, "feature", 12, 36, "feature_")},
logged AS (SELECT 'error:' || model || ':' || horizon || 'h' AS signal_key, 'model_error' AS kind, {SAID.format(g="worst")} AS severity FROM drifts
  UNION ALL SELECT 'feature:' || feature, 'market_feature', {SAID.format(g="grade")} FROM feature_g WHERE grade < 2),
appended AS (SELECT (SELECT max(origin_at) FROM scored) AS origin_at, * FROM logged WHERE severity <> 'none')"""


@query(f"WITH {SCORED}, {EVENTS} SELECT * FROM appended")
def drift_event_log(spark, sf_dir):
    """Warnings and severe signals that weren't stored yet for this origin."""
    return events(spark, sf_dir).select("origin_at", "signal_key", "kind", "severity")


@query(f"WITH {SCORED}, {EVENTS} SELECT signal_key, severity, CAST(row_number() OVER (ORDER BY origin_at DESC, signal_key DESC) AS INT) AS place FROM appended ORDER BY origin_at DESC, signal_key DESC LIMIT 10")
def recent_drift_events(spark, sf_dir):
    """The ten newest events: a report of a given length."""
    newest = events(spark, sf_dir).orderBy(F.desc("origin_at"), F.desc("signal_key")).limit(10)
    listed = newest.agg(F.reverse(F.array_sort(F.collect_list(F.struct("origin_at", "signal_key", "severity")))).alias("rows"))  # ten at most
    return listed.select(F.posexplode("rows")).select("col.signal_key", "col.severity", (F.col("pos") + 1).alias("place"))
