"""Queries on candles, gaps, features and regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import candles, features
from tidemark.plans.base import BARS, FINE, NOW, THINNED, TYPED, market, query, r6, table, thinned, typed



def now():
    return F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))


@query(f"WITH {BARS} SELECT ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars")
def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market(spark, sf_dir).select("ts", *[r6(c).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query(f"""WITH {TYPED}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS k FROM typed WHERE ts <= TIMESTAMP '2024-01-20 00:00:00')
SELECT series, ts, round(close, 6) AS close FROM r WHERE k <= 513""")
def newest_closed_candles(spark, sf_dir):
    """The closed candles at a time, at most 513 of each series."""
    at = F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))
    return candles.newest(typed(spark, sf_dir), at, 513).select("series", "ts", r6("close").alias("close"))


@query(f"""WITH {FINE}, b AS (
  SELECT series, time_bucket(INTERVAL '15 minutes', ts - INTERVAL 1 MICROSECOND) + INTERVAL '15 minutes' AS ts, arg_min(open, ts) AS open, max(high) AS high,
         min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS parts FROM fine GROUP BY 1, 2)
SELECT series, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM b WHERE parts = 3""")
def strict_quarter_hour_bars(spark, sf_dir):
    fine = candles.bars(table(spark, sf_dir, "events"), "5 minutes", F.col("event_type"))
    out = candles.strict_bars(fine, 3, "15 minutes")
    return out.select("series", "ts", *[r6(c).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query(f"""WITH {BARS}, r AS (SELECT *, row_number() OVER (ORDER BY ts DESC) - 1 AS k FROM bars) SELECT ts, round(close, 6) AS close FROM r WHERE k % 3 = 0""")
def stride_downsampled_closes(spark, sf_dir):
    return candles.stride_downsample(market(spark, sf_dir), 3).select("ts", r6("close").alias("close"))


GAPS = """gaps AS (
  SELECT series, b + INTERVAL 1 HOUR AS first_missing, ts - INTERVAL 1 HOUR AS last_missing, CAST((epoch(ts) - epoch(b)) / 3600 AS BIGINT) - 1 AS missing
  FROM (SELECT series, ts, lag(ts) OVER (PARTITION BY series ORDER BY ts) AS b FROM thinned) WHERE epoch(ts) - epoch(b) > 3600)"""


@query(f"WITH {THINNED}, {GAPS} SELECT * FROM gaps")
def missing_candle_runs(spark, sf_dir):
    return candles.missing_runs(thinned(spark, sf_dir))


OVERLAP = """both_ AS (
  SELECT a.series, a.ts, a.close, b.close AS other_close, abs(a.close - b.close) / nullif((a.close + b.close) / 2, 0) * 100 AS diff_pct,
         row_number() OVER (PARTITION BY a.series ORDER BY a.ts DESC) AS k
  FROM thinned a JOIN typed b ON a.series = b.series AND a.ts = b.ts),
report AS (
  SELECT series, count(*) AS common, avg(diff_pct) AS mean_diff_pct, max(diff_pct) AS max_diff_pct, count_if(diff_pct > 0.75) AS divergent FROM both_ WHERE k <= 24 GROUP BY 1),
agreed AS (
  SELECT *, CASE WHEN common < 6 THEN 'insufficient' WHEN max_diff_pct > 0.75 THEN 'divergent' ELSE 'agree' END AS status FROM report)"""


@query(f"WITH {THINNED}, {TYPED}, {OVERLAP} SELECT series, common, round(mean_diff_pct, 6) AS mean_diff_pct, round(max_diff_pct, 6) AS max_diff_pct, CAST(divergent AS BIGINT) AS divergent, status FROM agreed")
def overlap_of_providers(spark, sf_dir):
    out = candles.overlap_report(thinned(spark, sf_dir), typed(spark, sf_dir))
    return out.select("series", "common", r6("mean_diff_pct").alias("mean_diff_pct"), r6("max_diff_pct").alias("max_diff_pct"), "divergent", "status")


@query(f"WITH {THINNED}, {TYPED}, {OVERLAP} SELECT series, ts, round(diff_pct, 6) AS diff_pct FROM both_ WHERE diff_pct > 0.75")
def divergent_candles(spark, sf_dir):
    return candles.overlap(thinned(spark, sf_dir), typed(spark, sf_dir)).where("diff_pct > 0.75").select("series", "ts", r6("diff_pct").alias("diff_pct"))


@query(f"""WITH {THINNED}, {TYPED}, e AS (SELECT series, min(ts) AS low, max(ts) AS high FROM thinned GROUP BY 1)
SELECT t.series, t.ts, 'filled_by_secondary' AS kind FROM typed t JOIN e USING (series)
WHERE t.ts > e.low AND t.ts < e.high AND NOT EXISTS (SELECT 1 FROM thinned x WHERE x.series = t.series AND x.ts = t.ts)""")
def silent_fill_audit(spark, sf_dir):
    return candles.silent_fills(thinned(spark, sf_dir), typed(spark, sf_dir))


DECIDED = """decided AS (
  SELECT g.*, c.covered, status, CASE WHEN missing > 3 THEN 'withhold' WHEN covered = missing AND status = 'agree' THEN 'fill' WHEN covered = missing THEN 'degrade'
         WHEN missing <= 1 THEN 'degrade' ELSE 'withhold' END AS action
  FROM gaps g JOIN (SELECT g.series, g.first_missing, count(t.ts) AS covered FROM gaps g
    LEFT JOIN typed t ON t.series = g.series AND t.ts BETWEEN g.first_missing AND g.last_missing GROUP BY 1, 2) c USING (series, first_missing) LEFT JOIN agreed a USING (series))"""


@query(f"WITH {THINNED}, {TYPED}, {GAPS}, {OVERLAP}, {DECIDED} SELECT series, first_missing, last_missing, missing, covered, action FROM decided")
def gap_decisions(spark, sf_dir):
    out = candles.gap_decisions(thinned(spark, sf_dir), typed(spark, sf_dir))
    return out.select("series", "first_missing", "last_missing", "missing", "covered", "action")


@query(f"""WITH {THINNED}, {TYPED}, {GAPS}, {OVERLAP}, {DECIDED}
SELECT series, arg_max(action, CASE action WHEN 'withhold' THEN 3 WHEN 'degrade' THEN 2 ELSE 1 END) AS action, CAST(count_if(action = 'withhold') AS BIGINT) AS n_withhold,
       CAST(count_if(action = 'degrade') AS BIGINT) AS n_degrade, CAST(count_if(action = 'fill') AS BIGINT) AS n_fill FROM decided GROUP BY 1""")
def gap_run_policy(spark, sf_dir):
    return candles.run_action(candles.gap_decisions(thinned(spark, sf_dir), typed(spark, sf_dir)))


@query(f"""WITH {THINNED}, {TYPED}, {GAPS}, {OVERLAP}, {DECIDED}
SELECT series, ts, round(close, 6) AS close, volume, 'primary' AS provenance FROM thinned
UNION ALL SELECT t.series, t.ts, round(t.close, 6), t.volume, 'secondary' FROM typed t JOIN decided d ON t.series = d.series AND t.ts BETWEEN d.first_missing AND d.last_missing WHERE action = 'fill'""")
def backfilled_candles(spark, sf_dir):
    return candles.backfill(thinned(spark, sf_dir), typed(spark, sf_dir)).select("series", "ts", r6("close").alias("close"), "volume", "provenance")


@query(f"""WITH {TYPED}, w AS (
  SELECT *, epoch(ts) - epoch(lag(ts) OVER o) AS step, abs(close / nullif(lag(close) OVER o, 0) - 1) AS jump,
         median(volume) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS usual
  FROM typed WINDOW o AS (PARTITION BY series ORDER BY ts)), c AS (
  SELECT series, unnest(list_filter([
    CASE WHEN NOT isfinite(open) OR NOT isfinite(high) OR NOT isfinite(low) OR NOT isfinite(close) THEN 'non_finite_price' END,
    CASE WHEN least(open, high, low, close) <= 0 THEN 'non_positive_price' END, CASE WHEN volume < 0 THEN 'negative_volume' END,
    CASE WHEN high < greatest(open, close, low) THEN 'high_below_body' END, CASE WHEN low > least(open, close, high) THEN 'low_above_body' END,
    CASE WHEN step = 0 THEN 'duplicate_timestamp' END, CASE WHEN step > 3600 THEN 'missing_interval' END, CASE WHEN step % 3600 <> 0 THEN 'misaligned_interval' END,
    CASE WHEN epoch(ts) % 3600 <> 0 THEN 'off_lattice' END, CASE WHEN ts > {NOW} THEN 'future_candle' END,
    CASE WHEN volume > 20 * usual THEN 'extreme_volume' END, CASE WHEN jump > 0.5 THEN 'price_jump' END], lambda x: x IS NOT NULL)) AS code FROM w)
SELECT series, code, count(*) AS rows FROM c GROUP BY 1, 2
UNION ALL SELECT series, 'stale', 1 FROM typed GROUP BY 1 HAVING epoch({NOW}) - epoch(max(ts)) > 7200""")
def candle_validation(spark, sf_dir):
    return candles.validate(typed(spark, sf_dir), now())


QUALITY = candles.QualityLimits()


@query(f"""WITH {TYPED}, a AS (SELECT *, ts + CASE WHEN volume <= 1 THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END AS came FROM typed), w AS (
  SELECT *, epoch(ts) - epoch(lag(ts) OVER o) AS step, row_number() OVER o AS seen, lag(close) OVER o AS before, count(*) OVER g AS n, last(ts) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_ts,
    median(volume) OVER (o ROWS BETWEEN {QUALITY.lookback} PRECEDING AND 1 PRECEDING) AS usual, bool_and(isfinite(open) AND isfinite(high) AND isfinite(low) AND isfinite(close)) OVER g AS fin,
    bool_and(close > 0) OVER g AS closes, bool_and(low > 0) OVER g AS lows, bool_and(volume > 0) OVER g AS volumes
  FROM a WINDOW o AS (PARTITION BY series ORDER BY came, ts), g AS (PARTITION BY series)), c AS (SELECT series, unnest(list_filter([
    CASE WHEN seen = 1 AND n < {QUALITY.least_candles} THEN 'insufficient_candles' END, CASE WHEN epoch(ts) <= 0 THEN 'invalid_timestamp' END,
    {", ".join(f"CASE WHEN NOT isfinite({x}::DOUBLE) THEN 'non_finite_{x}' END, CASE WHEN {x} <= 0 THEN 'non_positive_{x}' END" for x in ("open", "high", "low", "close", "volume"))},
    CASE WHEN fin AND (high < greatest(open, close, low) OR low > least(open, close, high)) THEN 'invalid_ohlc' END,
    CASE WHEN fin AND closes AND abs(close / before - 1) * 100 > {QUALITY.return_pct} THEN 'extreme_hourly_return' END,
    CASE WHEN fin AND lows AND (high / low - 1) * 100 > {QUALITY.range_pct} THEN 'extreme_candle_range' END,
    CASE WHEN volumes AND seen > {QUALITY.least_history} AND volume / nullif(usual, 0) > {QUALITY.volume_ratio} THEN 'extreme_volume' END,
    CASE WHEN step = 0 THEN 'duplicate_timestamp' END, CASE WHEN step < 0 THEN 'out_of_order_timestamp' END, CASE WHEN step > 0 AND step <> {QUALITY.interval_seconds} THEN 'missing_or_irregular_candle' END,
    CASE WHEN seen = 1 AND epoch({NOW}) - epoch(last_ts) < -{QUALITY.future_seconds} THEN 'future_timestamp' END,
    CASE WHEN seen = 1 AND epoch({NOW}) - epoch(last_ts) > {QUALITY.stale_minutes * 60} THEN 'stale_data' END], lambda x: x IS NOT NULL)) AS code FROM w)
SELECT series, code, count(*) AS rows FROM c GROUP BY 1, 2""")
def candle_quality(spark, sf_dir):
    """All rules of the validator over series whose thin candles come three hours late."""
    late = F.col("ts") + F.when(F.col("volume") <= 1, F.expr("INTERVAL 3 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    return candles.quality_report(typed(spark, sf_dir).withColumn("came", late), now(), QUALITY, "came")


@query()
def winsorised_volume(spark, sf_dir):
    """Sequential: a cap's median sees earlier caps."""
    return candles.winsorise_volume(typed(spark, sf_dir), 24, 1.5).select("series", "ts", "volume", "capped_volume")


@query("""WITH raw AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(ts AS VARCHAR) AS ts, CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS v, value FROM events)
SELECT reason, count(*) AS rows FROM (SELECT unnest(list_filter([CASE WHEN try_cast(v AS DOUBLE) IS NULL THEN 'close_unparsable' END,
  CASE WHEN least(try_cast(v AS DOUBLE), value) <= 0 THEN 'non_positive' END], lambda x: x IS NOT NULL)) AS reason FROM raw) GROUP BY 1""")
def raw_row_audit(spark, sf_dir):
    """Reject reasons of rows whose columns are text."""
    e = table(spark, sf_dir, "events")
    close = F.when(F.col("event_id") % 97 == 0, "n/a").otherwise(F.col("value").cast("string"))
    same = F.col("value").cast("string")
    raw = e.select(F.col("ts").cast("string").alias("ts"), same.alias("open"), same.alias("high"), same.alias("low"), close.alias("close"), F.lit("1").alias("volume"))
    return candles.audit_rows(raw).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


RETURNS = "rets AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY series ORDER BY ts)) AS ret FROM bars)"
FEATURES = f"""{BARS}, {RETURNS}, f0 AS (
  SELECT *, close - lag(close) OVER o AS change, (high - low) / nullif(close, 0) * 100 AS range_pct, ln(1 + volume) AS lv, row_number() OVER o AS seen
  FROM rets WINDOW o AS (PARTITION BY series ORDER BY ts)), f1 AS (
  SELECT *, coalesce(stddev_samp(ret) OVER w6 * 100, 0) AS volatility_6h, coalesce(stddev_samp(ret) OVER w24 * 100, 0) AS volatility_24h, coalesce(stddev_samp(ret) OVER w168 * 100, 0) AS volatility_168h,
    avg(greatest(change, 0)) OVER w14 AS gain, avg(greatest(-change, 0)) OVER w14 AS loss, avg(range_pct) OVER w24 AS mean_range_24h,
    CASE WHEN stddev_pop(lv) OVER w168 > 1e-12 THEN (lv - avg(lv) OVER w168) / stddev_pop(lv) OVER w168 ELSE 0 END AS volume_z,
    coalesce((close / nullif(lag(close, 6) OVER o, 0) - 1) * 100, 0) AS momentum_6h, coalesce((close / nullif(lag(close, 24) OVER o, 0) - 1) * 100, 0) AS momentum_24h,
    coalesce((close / nullif(lag(close, 168) OVER o, 0) - 1) * 100, 0) AS momentum_168h
  FROM f0 WINDOW o AS (PARTITION BY series ORDER BY ts), w6 AS (PARTITION BY series ORDER BY ts ROWS 5 PRECEDING), w14 AS (PARTITION BY series ORDER BY ts ROWS 13 PRECEDING),
    w24 AS (PARTITION BY series ORDER BY ts ROWS 23 PRECEDING), w168 AS (PARTITION BY series ORDER BY ts ROWS 167 PRECEDING)), feats AS (
  SELECT *, CASE WHEN seen <= 14 THEN 50 WHEN loss <= 0 THEN CASE WHEN gain > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + gain / nullif(loss, 0)) END AS rsi_14 FROM f1), regimes AS (
  SELECT *, CASE WHEN volatility_24h > 1.35 * volatility_168h THEN 'high_volatility'
    WHEN abs(momentum_24h) > greatest(1, volatility_24h * sqrt(24) * 1.2) OR rsi_14 >= 70 OR rsi_14 <= 30 THEN 'trending' ELSE 'range' END AS regime FROM feats)"""
NAMES = ["volatility_6h", "volatility_24h", "volatility_168h", "mean_range_24h", "volume_z", "rsi_14", "momentum_6h", "momentum_24h", "momentum_168h"]


@query(f"WITH {FEATURES} SELECT ts, {', '.join(f'round({n}, 5) AS {n}' for n in NAMES)}, round(sin(hour(ts) * 2 * pi() / 24), 5) AS hour_sin, round(cos((isodow(ts) - 1) * 2 * pi() / 7), 5) AS weekday_cos FROM feats")
def market_features(spark, sf_dir):
    f = features.market_features(market(spark, sf_dir))
    return f.select("ts", *[F.round(n, 5).alias(n) for n in [*NAMES, "hour_sin", "weekday_cos"]])


def regimes(spark, sf_dir):
    return features.market_features(market(spark, sf_dir)).withColumn("regime", features.heuristic_regime())


@query(f"WITH {FEATURES} SELECT regime, count(*) AS rows, min(ts) AS first_at, max(ts) AS last_at FROM regimes GROUP BY 1")
def regime_counts(spark, sf_dir):
    return regimes(spark, sf_dir).groupBy("regime").agg(F.count("*").alias("rows"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


CONFIRMED = """changed AS (SELECT series, ts, regime AS label, coalesce(CAST(regime <> lag(regime) OVER (PARTITION BY series ORDER BY ts) AS INT), 0) AS ch FROM regimes),
runs AS (SELECT *, sum(ch) OVER (PARTITION BY series ORDER BY ts) AS run FROM changed), nth AS (SELECT *, row_number() OVER (PARTITION BY series, run ORDER BY ts) AS n, row_number() OVER (PARTITION BY series ORDER BY ts) AS k FROM runs),
confirmed AS (SELECT *, last_value(CASE WHEN n >= 2 OR k = 1 THEN label END IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts) AS confirmed FROM nth)"""


@query(f"""WITH {FEATURES}, {CONFIRMED}, m AS (SELECT ch, coalesce(CAST(confirmed <> lag(confirmed) OVER (PARTITION BY series ORDER BY ts) AS INT), 0) AS cc FROM confirmed)
SELECT 'raw' AS labels, count(*) AS rows, CAST(sum(ch) AS BIGINT) AS transitions, round(sum(ch) / (count(*) - 1), 6) AS churn FROM m
UNION ALL SELECT 'confirmed', count(*), CAST(sum(cc) AS BIGINT), round(sum(cc) / (count(*) - 1), 6) FROM m""")
def regime_churn(spark, sf_dir):
    """Transitions of raw regimes and of those confirmed twice."""
    labels = features.confirmed_labels(regimes(spark, sf_dir).select("series", "ts", F.col("regime").alias("label")))
    one = lambda c, name: features.churn(labels, c).select(F.lit(name).alias("labels"), "rows", "transitions", r6("churn").alias("churn"))
    return one("label", "raw").unionByName(one("confirmed", "confirmed"))


@query(f"WITH {FEATURES}, {CONFIRMED} SELECT ts, label, confirmed FROM confirmed")
def smoothed_regimes(spark, sf_dir):
    return features.confirmed_labels(regimes(spark, sf_dir).select("series", "ts", F.col("regime").alias("label"))).select("ts", "label", "confirmed")


@query(f"""WITH {FEATURES} SELECT CASE WHEN volatility_24h < 50 THEN 'low' WHEN volatility_24h < 100 THEN 'medium' ELSE 'high' END AS bucket, count(*) AS rows,
round(quantile_cont(volatility_24h, 0), 5) AS q0, round(quantile_cont(volatility_24h, 0.25), 5) AS q25, round(quantile_cont(volatility_24h, 0.5), 5) AS q50, round(quantile_cont(volatility_24h, 0.75), 5) AS q75, round(quantile_cont(volatility_24h, 1), 5) AS q100
FROM feats GROUP BY 1""")
def volatility_audit(spark, sf_dir):
    """Quantiles of realised volatility by bucket."""
    f = features.market_features(market(spark, sf_dir)).withColumn("bucket", features.volatility_bucket(F.col("volatility_24h"), 50, 100))
    quantiles = [F.round(F.percentile("volatility_24h", F.lit(q / 100)), 5).alias(f"q{q}") for q in (0, 25, 50, 75, 100)]
    return f.groupBy("bucket").agg(F.count("*").alias("rows"), *quantiles)
