"""Queries on intervals calibrated by regime and volatility, each event type being a series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import calibration, evaluate, features, ledger
from tidemark.plans.base import query, r6, typed
from tidemark.plans.forecast_queries import NOW, now
from tidemark.plans.replay_queries import SCORED_TYPED, scored_typed

BY = ["series", "model", "horizon"]
#: Hourly volatilities of the generated prices are tens of per cent.
CUTS = (50.0, 100.0)
P = calibration.Policy()


def _higher(s: str) -> str:
    return f"greatest(least({s}[CAST(ceil(least(1, ceil((len({s}) + 1) * {P.target}) / len({s})) * (len({s}) - 1)) AS INT) + 1], 3), 0.5)"


def _share(s: str, m: str) -> str:
    return f"len(list_filter({s}, lambda x: x <= {m})) / nullif(len({s}), 0)::DOUBLE"


G = ", ".join(BY)
BUCKETS = f"""{SCORED_TYPED}, states AS (
  SELECT series, ts, CASE WHEN volatility_6h > 0 THEN volatility_6h WHEN volatility_24h > 0 THEN volatility_24h END AS v FROM feats), hist AS (
  SELECT s.*, s.regime || ':' || CASE WHEN v IS NULL THEN 'unknown' WHEN v < {CUTS[0]} THEN 'low' WHEN v < {CUTS[1]} THEN 'medium' ELSE 'high' END AS bucket
  FROM scored s JOIN states t ON t.series = s.series AND t.ts = s.origin_at WHERE s.origin_at <= {NOW}), cur AS (
  SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY {G} ORDER BY origin_at DESC) = 1), sam AS (
  SELECT {G}, bucket, abs(actual - predicted) / ((q90 - q10) / 2) AS score, (q90 - q10) / predicted * 100 AS width,
    row_number() OVER (PARTITION BY {G} ORDER BY origin_at DESC) AS k_all, row_number() OVER (PARTITION BY {G}, bucket ORDER BY origin_at DESC) AS k_own
  FROM hist WHERE target_at <= {NOW} AND actual > 0 AND predicted > 0 AND q90 > q10), mar AS (
  SELECT {G}, list_sort(list(score)) AS ms FROM sam WHERE k_all <= {P.limit} GROUP BY ALL), marg AS (
  SELECT {G}, ms, CASE WHEN len(ms) >= {P.least} THEN {_higher("ms")} WHEN len(ms) >= 10 THEN greatest(least(sqrt({P.target} / greatest({_share("ms", "1")}, 0.1)), 1.75), 0.75) ELSE 1 END AS mm FROM mar), own AS (
  SELECT {G}, bucket, list_sort(list(score)) AS s, avg(width) AS width FROM sam WHERE k_own <= {P.limit} GROUP BY ALL), e0 AS (
  SELECT l.*, coalesce(len(s), 0) AS n, s, width, ms, coalesce(mm, 1) AS mm, CASE WHEN len(s) > 0 THEN {_higher("s")} END AS bm
  FROM (SELECT DISTINCT {G}, bucket FROM hist) l LEFT JOIN own USING ({G}, bucket) LEFT JOIN marg USING ({G})), e1 AS (
  SELECT *, CASE WHEN n >= {P.least} THEN bm ELSE n / {P.least}::DOUBLE * coalesce(bm, 0) + (1 - n / {P.least}::DOUBLE) * mm END AS mult,
    CASE WHEN n = 0 THEN 'marginal_fallback' WHEN n >= {P.least} THEN 'conformal' ELSE 'shrunken' END AS mode FROM e0), e2 AS (
  SELECT *, {_share("s", "mult")} AS after FROM e1), ent AS (
  SELECT *, coalesce(abs(after - {P.target}) <= {P.tolerance} + 1e-9, FALSE) AS ok FROM e2)"""
SECTION = f"""{BUCKETS}, guard AS (
  SELECT {G}, avg(CAST(score <= round(mult, 4) AS INT)) AS agg FROM sam JOIN ent USING ({G}, bucket) WHERE k_all <= {P.limit} GROUP BY ALL), viol AS (
  SELECT {G}, CAST(count_if(n >= {P.least} AND NOT ok) AS BIGINT) AS violations FROM ent GROUP BY ALL), sec0 AS (
  SELECT c.series, c.model, c.horizon, c.bucket, c.predicted, c.q10, c.q90, e.n, e.mode, e.mult, e.mm, e.after, e.ok, e.width, agg, violations,
    concat_ws(',', CASE WHEN mode <> 'conformal' THEN 'low_segment_evidence' END, CASE WHEN NOT ok THEN 'selected_segment_coverage_unverified' END,
      CASE WHEN coalesce(abs(agg - {P.target}) > {P.aggregate_tolerance} + 1e-9, TRUE) THEN 'aggregate_coverage_tolerance' END) AS reasons
  FROM cur c JOIN ent e USING ({G}, bucket) LEFT JOIN guard USING ({G}) LEFT JOIN viol USING ({G})), sec AS (
  SELECT *, round(CASE WHEN reasons = '' THEN mult ELSE mm END, 4) AS applied FROM sec0)"""


def with_states(spark, sf_dir):
    """Forecasts until now with the bucket of their origin, and the newest of each group."""
    volatility = calibration.realized_volatility(F.col("volatility_6h"), F.col("volatility_24h"))
    states = features.market_features(typed(spark, sf_dir)).select("series", F.col("ts").alias("origin_at"), volatility.alias("volatility"))
    rows = scored_typed(spark, sf_dir).where(F.col("origin_at") <= now()).join(states, ["series", "origin_at"])
    rows = rows.withColumn("bucket", calibration.state_bucket(F.col("regime"), F.col("volatility"), *CUTS))
    return rows, evaluate.newest_rows(rows, 1, *BY).select(*BY, "bucket", "predicted", "q10", "q90")


def section(spark, sf_dir):
    history, current = with_states(spark, sf_dir)
    return calibration.conditional_section(history, current, now(), BY, P)


@query(f"""WITH {BUCKETS} SELECT {G}, bucket, n AS samples, mode, round(bm, 4) AS bucket_multiplier, round(mm, 4) AS marginal_multiplier, round(mult, 4) AS multiplier, round({_share("s", "1")}, 6) AS coverage_before, round(after, 6) AS coverage_after,
  n >= {P.least} AND ok AS verified FROM ent""")
def conditional_buckets(spark, sf_dir):
    """The multiplier of every regime and volatility, shrunk where samples are few."""
    history, current = with_states(spark, sf_dir)
    out = calibration.bucket_calibration(history, current, now(), BY, P)
    rounded = [F.round(c, 4).alias(c) for c in ("bucket_multiplier", "marginal_multiplier", "multiplier")]
    return out.select(*BY, "bucket", "samples", "mode", *rounded, r6("coverage_before").alias("coverage_before"), r6("coverage_after").alias("coverage_after"), "verified")


@query(f"""WITH {SECTION} SELECT {G}, bucket, n AS samples, mode, reasons, violations, round(agg, 6) AS aggregate_coverage, applied AS applied_multiplier, round(width * applied, 4) AS width_after,
  round(greatest(0.01, predicted - (q90 - q10) / 2 / round(mm, 4) * applied), 2) AS low, round(predicted + (q90 - q10) / 2 / round(mm, 4) * applied, 2) AS high FROM sec""")
def conditional_section(spark, sf_dir):
    """The newest interval of each model and horizon, rescaled by its state's multiplier where the evidence bears it."""
    out = section(spark, sf_dir)
    return out.select(
        *BY, "bucket", "samples", "mode", F.array_join("fallback_reasons", ",").alias("reasons"), F.size("violations").cast("long").alias("violations"), r6("aggregate_coverage").alias("aggregate_coverage"), "applied_multiplier",
        F.round("width_after", 4).alias("width_after"), F.round("recalibrated_q10", 2).alias("low"), F.round("recalibrated_q90", 2).alias("high"),
    )


@query(f"""WITH {SECTION} SELECT series, model, count(*) AS horizons, CAST(count_if(n >= {P.least} AND ok) AS BIGINT) AS verified_horizons, CAST(count_if(mode <> 'conformal') AS BIGINT) AS sparse_horizons,
  CAST(sum(violations) AS BIGINT) AS violation_buckets, round(avg(after), 6) AS mean_coverage, round(avg(width * applied), 4) AS mean_width_pct,
  coalesce(string_agg(CAST(horizon AS VARCHAR), ',' ORDER BY horizon) FILTER (WHERE reasons <> ''), '') AS fallback_horizons FROM sec GROUP BY 1, 2""")
def conditional_report(spark, sf_dir):
    """How well each model's horizons are covered after calibration, and which fell back."""
    out = calibration.coverage_width_report(section(spark, sf_dir), "horizon", ["series", "model"])
    return out.select("series", "model", "horizons", "verified_horizons", "sparse_horizons", "violation_buckets", r6("mean_coverage").alias("mean_coverage"), F.round("mean_width_pct", 4).alias("mean_width_pct"), "fallback_horizons")


PROPOSED = f"""{BUCKETS}, dirs AS (
  SELECT {G}, count(*) AS hits, avg(CAST((predicted - source_price >= 0) = (actual - source_price >= 0) AS INT)) AS rate
  FROM hist WHERE target_at <= {NOW} AND actual > 0 AND predicted > 0 AND q90 > q10 AND source_price > 0 GROUP BY ALL), prop0 AS (
  SELECT {G}, bucket, n, after AS coverage, coalesce(hits, 0) AS hits, rate, round(mult, 4) AS recommended,
    CASE WHEN ok OR n < {P.least} THEN 'kept' WHEN abs(1 - round(mult, 4)) > 0.5 THEN 'unsafe_change' ELSE 'applied' END AS status
  FROM (SELECT {G}, bucket FROM cur) JOIN ent USING ({G}, bucket) LEFT JOIN dirs USING ({G})), prop AS (
  SELECT *, CASE WHEN status = 'applied' THEN greatest(0.9, least(recommended, 1.1)) ELSE 1.0 END AS moved,
    concat_ws(',', CASE WHEN hits >= {P.least} AND rate < 0.45 THEN 'direction_drift' END, CASE WHEN status = 'unsafe_change' THEN status END) AS alerts FROM prop0)"""


def proposals(spark, sf_dir):
    history, current = with_states(spark, sf_dir)
    unset = spark.createDataFrame([], "series string, model string, horizon int, multiplier double")
    return calibration.rolling_recalibration(history, current, unset, now(), BY, P)


@query(f"WITH {PROPOSED} SELECT {G}, bucket, n AS samples, round(coverage, 6) AS coverage, hits, round(rate, 6) AS hit_rate, recommended, status, round(moved, 6) AS after, alerts FROM prop")
def bucket_recalibration(spark, sf_dir):
    """Bounded changes of the multiplier of each model's present state, and what is refused or alerted."""
    out = proposals(spark, sf_dir)
    return out.select(*BY, "bucket", "samples", r6("coverage").alias("coverage"), "hits", r6("hit_rate").alias("hit_rate"), "recommended", "status", r6("after").alias("after"), F.array_join("alerts", ",").alias("alerts"))


@query(f"""WITH {PROPOSED}, done AS (SELECT concat_ws('/', series, model, CAST(horizon AS VARCHAR)) AS key, status, moved FROM prop WHERE status <> 'kept')
SELECT {NOW} AS at, 'recalibrate' AS action, key, status, 1.0::DOUBLE AS before, round(moved, 6) AS after FROM done
UNION ALL SELECT {NOW} + INTERVAL 1 HOUR, 'rollback', key, 'rolled_back', round(moved, 6), 1.0::DOUBLE FROM done WHERE status = 'applied'""")
def recalibration_audit(spark, sf_dir):
    """The log after a recalibration, written twice, and its rollback an hour later."""
    made = proposals(spark, sf_dir)
    once = ledger.appended(calibration.audited(made, BY, now()), None)
    log = once.unionByName(ledger.appended(calibration.audited(made, BY, now()), once))
    held = made.select(F.concat_ws("/", *[F.col(c).cast("string") for c in BY]).alias("key"), F.col("after").alias("multiplier"))
    undone = ledger.rollback(held, log, now() + F.expr("INTERVAL 1 HOUR"))[1]
    return log.unionByName(undone).select("at", "action", "key", "status", r6("before").alias("before"), r6("after").alias("after"))
