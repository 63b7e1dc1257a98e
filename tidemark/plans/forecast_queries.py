"""Queries on forecasts, their scores, weights and calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions import scalars
from tidemark.operators import evaluate, features, forecasts, moments
from tidemark.plans.base import market, query, r6, typed
from tidemark.plans.candle_queries import FEATURES, regimes

H = "(VALUES (2), (4), (8), (16)) h(horizon)"
SCORED = f"""{FEATURES}, b0 AS (
  SELECT series, ts, close, row_number() OVER o AS seen, greatest(coalesce(stddev_pop(ret) OVER w168, 0), 1e-6) AS sd, avg(ret) OVER w168 AS m168, avg(ret) OVER w24 AS m24,
         lag(close, 22) OVER o AS d2, lag(close, 20) OVER o AS d4, lag(close, 16) OVER o AS d8, lag(close, 8) OVER o AS d16
  FROM rets WINDOW o AS (PARTITION BY series ORDER BY ts), w168 AS (PARTITION BY series ORDER BY ts ROWS 167 PRECEDING), w24 AS (PARTITION BY series ORDER BY ts ROWS 23 PRECEDING)), b1 AS (
  SELECT *, greatest(least(m168, 2 * sd), -2 * sd) AS drift, greatest(least(m24, 2 * sd), -2 * sd) AS mom FROM b0 WHERE seen > 24 AND close > 0), b2 AS (
  SELECT series, ts AS origin_at, close AS source_price, horizon, sd, ts + horizon * INTERVAL 1 HOUR AS target_at, close AS p1, close * exp(drift * horizon) AS p2, close * exp(mom * horizon) AS p3,
         CASE horizon WHEN 2 THEN d2 WHEN 4 THEN d4 WHEN 8 THEN d8 ELSE d16 END AS p4, close * exp((drift + mom) * horizon / 3) AS p5 FROM b1, {H}), fc AS (
  SELECT series, origin_at, horizon, target_at, source_price, sd, 'persistence' AS model, p1 AS predicted FROM b2 UNION ALL SELECT series, origin_at, horizon, target_at, source_price, sd, 'drift', p2 FROM b2
  UNION ALL SELECT series, origin_at, horizon, target_at, source_price, sd, 'momentum', p3 FROM b2 UNION ALL SELECT series, origin_at, horizon, target_at, source_price, sd, 'seasonal', p4 FROM b2
  UNION ALL SELECT series, origin_at, horizon, target_at, source_price, sd, 'blend', p5 FROM b2), fq AS (
  SELECT *, predicted * exp(-1.2815515655446004 * sd * sqrt(horizon)) AS q10, predicted * exp(1.2815515655446004 * sd * sqrt(horizon)) AS q90 FROM fc), s0 AS (
  SELECT f.*, b.close AS actual, r.regime FROM fq f LEFT JOIN bars b ON b.ts = f.target_at JOIN regimes r ON r.ts = f.origin_at), scored AS (
  SELECT *, abs(predicted - actual) / nullif(actual, 0) * 100 AS abs_pct, (predicted - actual) / nullif(actual, 0) * 100 AS signed_pct, (actual / nullif(source_price, 0) - 1) * 100 AS actual_change_pct,
         (predicted / nullif(source_price, 0) - 1) * 100 AS predicted_change_pct,
         CAST((CASE WHEN predicted - source_price > 0.005 THEN 1 WHEN predicted - source_price < -0.005 THEN -1 ELSE 0 END) = (CASE WHEN actual - source_price > 0.005 THEN 1 WHEN actual - source_price < -0.005 THEN -1 WHEN actual IS NOT NULL THEN 0 END) AS INT) AS direction_correct,
         q10 <= actual AND actual <= q90 AS within FROM s0)"""
METRICS = "count(abs_pct) AS samples, round(avg(abs_pct), 5) AS mae_pct, round(avg(signed_pct), 5) AS bias_pct, round(avg(direction_correct), 6) AS direction_accuracy, round(avg(CAST(within AS INT)), 6) AS coverage"
NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def now():
    return F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))


def scored(spark, sf_dir):
    bars = market(spark, sf_dir)
    labels = regimes(spark, sf_dir).select("series", F.col("ts").alias("origin_at"), "regime")
    return forecasts.scored(forecasts.baselines(bars), bars).join(labels, ["series", "origin_at"])


def shown(df, *by):
    return df.select(*by, "samples", *[F.round(c, 5).alias(c) for c in ("mae_pct", "bias_pct")], *[r6(c).alias(c) for c in ("direction_accuracy", "coverage")])


@query(f"WITH {SCORED} SELECT model, horizon, {METRICS} FROM scored WHERE actual IS NOT NULL AND target_at <= {NOW} GROUP BY 1, 2")
def performance_summary(spark, sf_dir):
    """Matured forecasts by model and horizon: the flagship query."""
    from tidemark.operators.pit import matured

    return shown(evaluate.summary(matured(scored(spark, sf_dir), now()), "model", "horizon"), "model", "horizon")


@query(f"WITH {SCORED} SELECT origin_at, model, horizon, target_at, round(ln(predicted), 6) AS log_predicted, round(ln(q10), 6) AS log_q10, round(ln(q90), 6) AS log_q90, round(actual, 5) AS actual, coalesce(CAST(CAST(within AS INT) AS VARCHAR), 'unknown') AS hit FROM scored")
def scored_forecasts(spark, sf_dir):
    return scored(spark, sf_dir).select("origin_at", "model", "horizon", "target_at", *[r6(F.log(c)).alias(f"log_{c}") for c in ("predicted", "q10", "q90")], F.round("actual", 5).alias("actual"), F.coalesce(F.col("within").cast("int").cast("string"), F.lit("unknown")).alias("hit"))


@query(f"WITH {SCORED} SELECT count(*) AS predictions, count(DISTINCT origin_at) AS origins, CAST(count_if(actual IS NOT NULL) AS BIGINT) AS matured, min(origin_at) AS first_origin, max(origin_at) AS last_origin, arg_max(regime, origin_at) AS last_regime FROM scored")
def store_stats(spark, sf_dir):
    return scored(spark, sf_dir).agg(
        F.count("*").alias("predictions"), F.countDistinct("origin_at").alias("origins"), F.count_if(F.col("actual").isNotNull()).alias("matured"),
        F.min("origin_at").alias("first_origin"), F.max("origin_at").alias("last_origin"), F.max_by("regime", "origin_at").alias("last_regime"),
    )


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY model, horizon ORDER BY origin_at DESC) AS k FROM scored WHERE actual IS NOT NULL)
SELECT model, horizon, origin_at, round(predicted, 5) AS predicted, round(actual, 5) AS actual, round(abs_pct, 5) AS abs_pct, direction_correct FROM r WHERE k = 1""")
def latest_matured(spark, sf_dir):
    rows = evaluate.newest_rows(scored(spark, sf_dir).where("actual IS NOT NULL"), 1, "model", "horizon")
    return rows.select("model", "horizon", "origin_at", *[F.round(c, 5).alias(c) for c in ("predicted", "actual", "abs_pct")], "direction_correct")


@query(f"""WITH {SCORED}, g AS (SELECT * FROM (VALUES (2), (4), (8), (16), (24)) a(horizon), (VALUES ('persistence'), ('drift'), ('blend')) b(model), (VALUES ('high_volatility'), ('trending'), ('range'), ('unknown')) c(regime)),
m AS (SELECT horizon, model, regime, {METRICS} FROM scored GROUP BY 1, 2, 3)
SELECT horizon, model, regime, coalesce(samples, 0) AS samples, mae_pct, bias_pct, direction_accuracy, coverage, CASE WHEN coalesce(samples, 0) = 0 THEN 'no_samples' WHEN samples < 30 THEN 'low_samples' END AS warning FROM g LEFT JOIN m USING (horizon, model, regime)""")
def evidence_by_horizon_model_regime(spark, sf_dir):
    """Every cell, empty ones too."""
    grid = evaluate.evidence_grid(scored(spark, sf_dir), {"horizon": [2, 4, 8, 16, 24], "model": ["persistence", "drift", "blend"], "regime": ["high_volatility", "trending", "range", "unknown"]})
    out = shown(grid.withColumn("horizon", F.col("horizon").cast("int")), "horizon", "model", "regime", "warning")
    return out


@query(f"""WITH {SCORED}, w AS (SELECT 'all' AS "window", * FROM scored UNION ALL SELECT '7d', * FROM scored WHERE origin_at >= {NOW} - INTERVAL 7 DAY UNION ALL SELECT '14d', * FROM scored WHERE origin_at >= {NOW} - INTERVAL 14 DAY)
SELECT "window", model, horizon, {METRICS} FROM w GROUP BY 1, 2, 3""")
def rolling_window_report(spark, sf_dir):
    return shown(evaluate.windows_report(scored(spark, sf_dir), now(), [7, 14], "model", "horizon"), "window", "model", "horizon")


DIMS = {
    "horizon": "CAST(horizon AS VARCHAR)", "model": "model", "regime": "regime",
    "weekday": "['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday'][isodow(origin_at)]",
    "time_of_day": "CASE WHEN hour(origin_at) < 6 THEN 'night' WHEN hour(origin_at) < 12 THEN 'morning' WHEN hour(origin_at) < 18 THEN 'afternoon' ELSE 'evening' END",
}


@query(f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {e} AS segment, {METRICS} FROM scored GROUP BY 2" for d, e in DIMS.items()) + f" UNION ALL SELECT 'overall', 'all', {METRICS} FROM scored")
def segment_report(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumns({"weekday": scalars.weekday_label(F.col("origin_at")), "time_of_day": scalars.time_of_day(F.col("origin_at"))})
    return shown(evaluate.segments(rows, list(DIMS)), "dimension", "segment")


PAIRS = """pairs AS (SELECT c.*, b.abs_pct AS abs_b, b.predicted AS pred_b, b.direction_correct AS dir_b FROM scored c JOIN scored b ON c.series = b.series AND c.origin_at = b.origin_at AND c.horizon = b.horizon
  WHERE c.model = 'blend' AND b.model = 'persistence' AND c.actual = b.actual)"""


@query(f"""WITH {SCORED}, {PAIRS}, k AS (SELECT horizon, regime, count(*) AS pairs, avg(abs_pct) AS c, avg(abs_b) AS b FROM pairs GROUP BY 1, 2)
SELECT horizon, regime, pairs, round(1 - c / nullif(b, 0), 6) AS skill, CASE WHEN 1 - c / nullif(b, 0) > 0.02 THEN 'positive' WHEN 1 - c / nullif(b, 0) < -0.02 THEN 'negative' WHEN nullif(b, 0) IS NULL THEN 'unknown' ELSE 'neutral' END AS edge FROM k""")
def skill_against_persistence(spark, sf_dir):
    rows = scored(spark, sf_dir)
    paired = evaluate.pairs(rows, "blend", "persistence").join(rows.select("series", "origin_at", "regime").distinct(), ["series", "origin_at"])
    return evaluate.skill(paired, "horizon", "regime").select("horizon", "regime", "pairs", r6("skill").alias("skill"), "edge")


@query(f"""WITH {SCORED}, {PAIRS} SELECT strftime(target_at, '%Y-%W') AS period, count(*) AS pairs, round(avg(abs_b - abs_pct), 5) AS mean_gain_pct, CAST(count_if(abs_b > abs_pct) AS BIGINT) AS better, CAST(count_if(abs_b < abs_pct) AS BIGINT) AS worse FROM pairs GROUP BY 1""")
def periodic_stability(spark, sf_dir):
    """The candidate's gain in each week, weeks counted from the year's first Monday."""
    paired = evaluate.pairs(scored(spark, sf_dir), "blend", "persistence")
    week = F.floor((F.dayofyear("target_at") + 6 - F.weekday("target_at")) / 7)
    period = F.concat(F.year("target_at"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))
    gain = F.col("abs_pct_b") - F.col("abs_pct_c")
    return paired.groupBy(period.alias("period")).agg(F.count("*").alias("pairs"), F.round(F.avg(gain), 5).alias("mean_gain_pct"), F.count_if(gain > 0).alias("better"), F.count_if(gain < 0).alias("worse"))


@query(f"""WITH {SCORED} SELECT model, CAST(count_if(actual IS NULL) AS BIGINT) AS waiting, CAST(count_if(target_at > {NOW}) AS BIGINT) AS future, CAST(count_if(actual IS NOT NULL AND predicted IS NULL) AS BIGINT) AS without_forecast, CAST(count_if(abs_pct IS NOT NULL) AS BIGINT) AS usable FROM scored GROUP BY 1""")
def pairing_diagnostics(spark, sf_dir):
    a, p = F.col("actual"), F.col("predicted")
    return scored(spark, sf_dir).groupBy("model").agg(
        F.count_if(a.isNull()).alias("waiting"), F.count_if(F.col("target_at") > now()).alias("future"), F.count_if(a.isNotNull() & p.isNull()).alias("without_forecast"), F.count_if(F.col("abs_pct").isNotNull()).alias("usable")
    )


CLASS = "CASE WHEN {0} > 0.5 THEN 'up' WHEN {0} < -0.5 THEN 'down' ELSE 'neutral' END"
CONFUSION = f"confusion AS (SELECT model, horizon, {CLASS.format('predicted_change_pct')} AS said, {CLASS.format('actual_change_pct')} AS was, count(*) AS rows FROM scored WHERE actual IS NOT NULL GROUP BY 1, 2, 3, 4)"


@query(f"WITH {SCORED}, {CONFUSION} SELECT * FROM confusion")
def direction_confusion(spark, sf_dir):
    return evaluate.confusion(scored(spark, sf_dir), 0.5, "model", "horizon")


@query(f"""WITH {SCORED}, {CONFUSION}, a AS (SELECT model, horizon, said AS label, sum(rows) AS n_said, sum(CASE WHEN said = was THEN rows ELSE 0 END) AS good FROM confusion GROUP BY 1, 2, 3), b AS (SELECT model, horizon, was AS label, sum(rows) AS n_was FROM confusion GROUP BY 1, 2, 3),
c AS (SELECT model, horizon, label, coalesce(n_said, 0) AS n_said, coalesce(n_was, 0) AS n_was, coalesce(good, 0) AS good FROM a FULL JOIN b USING (model, horizon, label))
SELECT model, horizon, label, CAST(n_said AS BIGINT) AS n_said, CAST(n_was AS BIGINT) AS n_was, round(good / nullif(n_said, 0), 6) AS precision, round(good / nullif(n_was, 0), 6) AS recall, round(avg(good / nullif(n_was, 0)) OVER (PARTITION BY model, horizon), 6) AS balanced_accuracy FROM c""")
def direction_precision_recall(spark, sf_dir):
    out = evaluate.precision_recall(evaluate.confusion(scored(spark, sf_dir), 0.5, "model", "horizon"), "model", "horizon")
    return out.select("model", "horizon", "label", "n_said", "n_was", *[r6(c).alias(c) for c in ("precision", "recall", "balanced_accuracy")])


@query(f"WITH {SCORED} SELECT regime, model, count(*) AS rows, round(sum(CASE WHEN within THEN 1 ELSE 0 END) / count(*), 6) AS hit_share FROM scored GROUP BY 1, 2")
def conditional_coverage(spark, sf_dir):
    """Rows without an outcome count as misses."""
    hits = F.count_if(F.coalesce("within", F.lit(False)))
    return scored(spark, sf_dir).groupBy("regime", "model").agg(F.count("*").alias("rows"), r6(hits / F.count("*")).alias("hit_share"))


@query(f"""WITH {SCORED}, e AS (SELECT *, CASE WHEN predicted_change_pct > 0.15 THEN 1 WHEN predicted_change_pct < -0.15 THEN -1 ELSE 0 END AS pos FROM scored WHERE actual IS NOT NULL)
SELECT model, horizon, count(*) AS signals, CAST(count_if(pos <> 0) AS BIGINT) AS acted, round(avg(pos * actual_change_pct), 5) AS gross_pct, round(avg(CASE WHEN pos = 0 THEN 0 ELSE pos * actual_change_pct - 0.15 END), 5) AS net_pct, round(count_if(pos <> 0) / count(*), 6) AS turnover FROM e GROUP BY 1, 2""")
def economic_value(spark, sf_dir):
    acted = F.count_if(F.col("position") != 0)
    return evaluate.economic(scored(spark, sf_dir)).groupBy("model", "horizon").agg(
        F.count("*").alias("signals"), acted.alias("acted"), F.round(F.avg("gross"), 5).alias("gross_pct"), F.round(F.avg("net"), 5).alias("net_pct"), r6(acted / F.count("*")).alias("turnover")
    )


PIN = "avg(greatest({q} * (actual - {c}), ({q} - 1) * (actual - {c})))"
MISS = "(CASE WHEN actual < q10 THEN q10 - actual WHEN actual > q90 THEN actual - q90 ELSE 0 END)"


@query(f"""WITH {SCORED} SELECT model, horizon, count(*) AS rows, round({PIN.format(q=0.1, c='q10')}, 5) AS pinball_10, round({PIN.format(q=0.5, c='predicted')}, 5) AS pinball_50, round({PIN.format(q=0.9, c='q90')}, 5) AS pinball_90,
round(avg(q90 - q10 + 2 / 0.2 * {MISS}), 4) AS winkler, round(avg((q90 - q10) / 0.2 + 2 / 0.2 * {MISS}), 4) AS interval_score, round(avg((q90 - q10) / nullif(source_price, 0) * 100), 4) AS width_pct, round(abs(avg(CAST(within AS INT)) - 0.8), 6) AS coverage_error
FROM scored WHERE actual IS NOT NULL AND q10 IS NOT NULL GROUP BY 1, 2""")
def distributional_scores(spark, sf_dir):
    out = evaluate.distributional(scored(spark, sf_dir), "model", "horizon")
    return out.select("model", "horizon", "rows", *[F.round(c, 5).alias(c) for c in ("pinball_10", "pinball_50", "pinball_90")], *[F.round(c, 4).alias(c) for c in ("winkler", "interval_score", "width_pct")], r6("coverage_error").alias("coverage_error"))


@query(f"""WITH {SCORED}, l AS (SELECT *, list(abs_pct) OVER (PARTITION BY model, horizon ORDER BY origin_at ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) AS past FROM scored WHERE abs_pct IS NOT NULL)
SELECT model, horizon, origin_at, round(abs_pct, 5) AS abs_pct, round(CASE WHEN len(past) >= 12 THEN list_sort(past)[CAST(ceil(0.8 * len(past)) AS INT)] END, 5) AS band FROM l""")
def causal_error_bands(spark, sf_dir):
    out = evaluate.causal_quantile(scored(spark, sf_dir).where("abs_pct IS NOT NULL"), 0.8, 48, 12, "model", "horizon")
    return out.select("model", "horizon", "origin_at", F.round("abs_pct", 5).alias("abs_pct"), F.round("band", 5).alias("band"))


@query(f"""WITH {SCORED}, c AS (SELECT model, horizon, list_sort(list(abs(actual - predicted) / nullif((q90 - q10) / 2, 0))) AS s, avg(CAST(within AS INT)) AS cov FROM scored WHERE actual IS NOT NULL AND q10 IS NOT NULL GROUP BY 1, 2)
SELECT model, horizon, len(s) AS samples, round(cov, 6) AS coverage, round(greatest(least(s[CAST(ceil(least(1, ceil((len(s) + 1) * 0.8) / len(s)) * (len(s) - 1)) AS INT) + 1], 3), 0.5), 6) AS multiplier FROM c""")
def conformal_multipliers(spark, sf_dir):
    out = evaluate.conformal(scored(spark, sf_dir), 0.8, "model", "horizon")
    return out.select("model", "horizon", F.col("samples").cast("long").alias("samples"), r6("coverage").alias("coverage"), r6("multiplier").alias("multiplier"))


@query(f"""WITH {SCORED}, v AS (SELECT s.*, CASE WHEN volatility_24h < 50 THEN 'low' WHEN volatility_24h < 100 THEN 'medium' ELSE 'high' END AS vol FROM scored s JOIN feats f ON f.ts = s.origin_at),
c AS (SELECT regime, vol, list_sort(list(abs(actual - predicted) / nullif((q90 - q10) / 2, 0))) AS s, avg(CAST(within AS INT)) AS cov FROM v WHERE actual IS NOT NULL AND model = 'blend' GROUP BY 1, 2)
SELECT regime, vol, len(s) AS samples, round(cov, 6) AS coverage, round(CASE WHEN len(s) >= 20 THEN greatest(least(s[CAST(ceil(least(1, ceil((len(s) + 1) * 0.8) / len(s)) * (len(s) - 1)) AS INT) + 1], 3), 0.5)
 WHEN len(s) >= 10 THEN greatest(least(sqrt(0.8 / greatest(cov, 0.1)), 1.75), 0.75) ELSE 1 END, 6) AS multiplier FROM c""")
def bucketed_conformal(spark, sf_dir):
    """Calibration within regime and volatility buckets."""
    vol = features.market_features(market(spark, sf_dir)).select("series", F.col("ts").alias("origin_at"), features.volatility_bucket(F.col("volatility_24h"), 50, 100).alias("vol"))
    out = evaluate.conformal(scored(spark, sf_dir).where("model = 'blend'").join(vol, ["series", "origin_at"]), 0.8, "regime", "vol")
    return out.select("regime", "vol", F.col("samples").cast("long").alias("samples"), r6("coverage").alias("coverage"), r6("multiplier").alias("multiplier"))


RATE = "rates AS (SELECT *, coalesce(sum(CAST(actual_change_pct > 0 AS INT)) OVER w, 0) AS hits, count(*) OVER w AS n FROM scored WHERE model = 'blend' AND actual IS NOT NULL WINDOW w AS (PARTITION BY horizon, predicted_change_pct > 0 ORDER BY origin_at ROWS BETWEEN UNBOUNDED PRECEDING AND 17 PRECEDING))"


def up_probability(spark, sf_dir):
    """The smoothed rate of rises after alike signals whose outcomes were known, 17 or more rows before."""
    frame = W.partitionBy("horizon", F.col("predicted_change_pct") > 0).orderBy("origin_at").rowsBetween(W.unboundedPreceding, -17)
    rose = (F.col("actual_change_pct") > 0).cast("int")
    rows = scored(spark, sf_dir).where("model = 'blend' AND actual IS NOT NULL").withColumn("rose", rose)
    return rows.withColumns({"hits": F.coalesce(F.sum("rose").over(frame), F.lit(0)), "n": F.count("*").over(frame)}).withColumn("p", scalars.smoothed_rate(F.col("hits"), F.col("n")))


@query(f"WITH {SCORED}, {RATE} SELECT horizon, count(*) AS rows, round(avg((hits + 0.5) / (n + 1)), 6) AS mean_probability, round(avg(power((hits + 0.5) / (n + 1) - CAST(actual_change_pct > 0 AS INT), 2)), 6) AS brier FROM rates GROUP BY 1")
def direction_probability(spark, sf_dir):
    rows = up_probability(spark, sf_dir)
    return rows.groupBy("horizon").agg(F.count("*").alias("rows"), r6(F.avg("p")).alias("mean_probability"), r6(F.avg(F.pow(F.col("p") - F.col("rose"), F.lit(2)))).alias("brier"))


@query(f"""WITH {SCORED}, {RATE}, p AS (SELECT (hits + 0.5) / (n + 1) AS p, CAST(actual_change_pct > 0 AS INT) AS rose FROM rates), b AS (SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS rows, avg(p) AS f, avg(rose) AS r FROM p GROUP BY 1)
SELECT bin, rows, round(f, 6) AS mean_forecast, round(r, 6) AS rate, round((SELECT sum(rows * abs(f - r)) / sum(rows) FROM b), 6) AS ece FROM b""")
def reliability_table(spark, sf_dir):
    out = evaluate.reliability(up_probability(spark, sf_dir), F.col("p"), F.col("rose"))
    return out.select("bin", "rows", r6("mean_forecast").alias("mean_forecast"), r6("rate").alias("rate"), r6("ece").alias("ece"))


@query(f"""WITH {SCORED}, t AS (SELECT horizon, count(*) AS n, stddev_samp(actual_change_pct) AS sd FROM scored WHERE model = 'persistence' AND actual IS NOT NULL GROUP BY 1), u AS (SELECT *, greatest(least(1.95996 * sd / sqrt(n), 2), 0.05) AS neutral FROM t)
SELECT horizon, n AS samples, round(CASE WHEN n < 20 THEN 0.25 ELSE neutral END, 6) AS neutral_pct, round(CASE WHEN n < 20 THEN 0.5 ELSE greatest(least(2.57583 * sd / sqrt(n), 4), neutral) END, 6) AS no_edge_pct FROM u""")
def dynamic_thresholds(spark, sf_dir):
    """Changes that are told from none at two levels, bounded, and fixed where samples are few."""
    out = scored(spark, sf_dir).where("model = 'persistence' AND actual IS NOT NULL").groupBy("horizon").agg(F.count("*").alias("samples"), F.stddev_samp("actual_change_pct").alias("sd"))
    error = F.col("sd") / F.sqrt("samples")
    out = out.withColumn("neutral", F.greatest(F.least(1.95996 * error, F.lit(2.0)), F.lit(0.05)))
    few = F.col("samples") < 20
    edge = F.greatest(F.least(2.57583 * error, F.lit(4.0)), F.col("neutral"))
    return out.select("horizon", "samples", r6(F.when(few, 0.25).otherwise(F.col("neutral"))).alias("neutral_pct"), r6(F.when(few, 0.5).otherwise(edge)).alias("no_edge_pct"))


SCORE = """scores AS (SELECT horizon, model, count(*) AS samples, exp(-2.5 * avg(abs_pct) / 100) * (1 + 0.25 * (avg(direction_correct) - 0.5) * 2) * exp(-0.35 * abs(avg(signed_pct)) / 100) * CASE WHEN count(within) >= 3 THEN exp(-0.35 * abs(avg(CAST(within AS INT)) - 0.8)) ELSE 1 END AS score
  FROM scored WHERE actual IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {SCORED}, {SCORE} SELECT horizon, model, samples, round(score, 6) AS score, round(score / sum(score) OVER (PARTITION BY horizon), 6) AS share FROM scores")
def adaptive_model_scores(spark, sf_dir):
    out = evaluate.adaptive_scores(scored(spark, sf_dir), "horizon", "model")
    share = F.col("score") / F.sum("score").over(W.partitionBy("horizon"))
    return out.select("horizon", "model", "samples", r6("score").alias("score"), r6(share).alias("share"))


@query()
def bounded_adaptive_weights(spark, sf_dir):
    """Scores scaled to weights within 0.03 and 0.55 that sum to 1."""
    out = evaluate.adaptive_scores(scored(spark, sf_dir), "horizon", "model").groupBy("horizon").agg(F.sort_array(F.collect_list(F.struct("model", "score"))).alias("m"))
    weights = scalars.bounded_normalize(F.col("m.score"))
    return out.select("horizon", F.inline(F.arrays_zip(F.col("m.model").alias("model"), weights.alias("weight")))).select("horizon", "model", r6("weight").alias("weight"))


@query(f"""WITH {SCORED}, k AS (SELECT series, origin_at, horizon, model, signed_pct FROM scored WHERE actual IS NOT NULL AND predicted IS NOT NULL)
SELECT a.horizon, a.model, b.model AS other, count(*) AS pairs, round(covar_pop(a.signed_pct, b.signed_pct) / nullif(stddev_pop(a.signed_pct) * stddev_pop(b.signed_pct), 0), 5) AS rho FROM k a JOIN k b ON a.series = b.series AND a.origin_at = b.origin_at AND a.horizon = b.horizon AND a.model < b.model GROUP BY 1, 2, 3""")
def residual_correlations(spark, sf_dir):
    out = evaluate.residual_correlations(scored(spark, sf_dir).where("predicted IS NOT NULL"), 12, "horizon")
    return out.select("horizon", "model", "other", "pairs", F.round("rho", 5).alias("rho"))


@query(f"""WITH {SCORED}, a AS (SELECT model, horizon, abs_pct, (epoch({NOW}) - epoch(target_at)) / 3600 AS age FROM scored WHERE actual IS NOT NULL), w AS (SELECT *, exp(-ln(2) * age / 168) AS w FROM a)
SELECT model, horizon, count(*) AS rows, round(sum(w * abs_pct) / sum(w), 5) AS decayed_mae_pct, round(sum(w) * sum(w) / nullif(sum(w * w), 0), 5) AS effective_samples FROM w GROUP BY 1, 2""")
def decayed_pool(spark, sf_dir):
    """Errors weighted by age with a half-life of a week, and how many samples that is worth."""
    age = (F.unix_timestamp(now().cast("timestamp")) - F.unix_timestamp(F.col("target_at").cast("timestamp"))) / 3600
    rows = scored(spark, sf_dir).where("actual IS NOT NULL").withColumn("w", scalars.decay_weight(age, 168))
    return rows.groupBy("model", "horizon").agg(F.count("*").alias("rows"), F.round(F.sum(F.col("w") * F.col("abs_pct")) / F.sum("w"), 5).alias("decayed_mae_pct"), F.round(scalars.effective_sample_size(F.col("w")), 5).alias("effective_samples"))


@query(f"""WITH {SCORED}, n AS (SELECT origin_at, model, horizon, q10, q90, lag(q10) OVER o AS p10, lag(q90) OVER o AS p90, predicted_change_pct AS c, lag(predicted_change_pct) OVER o AS pc FROM scored WHERE predicted IS NOT NULL WINDOW o AS (PARTITION BY origin_at, model ORDER BY horizon))
SELECT model, horizon, CAST(count_if(q10 > q90) AS BIGINT) AS crossed, CAST(coalesce(count_if(q10 > p10 OR q90 < p90), 0) AS BIGINT) AS narrowed, CAST(coalesce(count_if(c * pc < 0 AND abs(c - pc) > 0.25), 0) AS BIGINT) AS flipped FROM n GROUP BY 1, 2""")
def horizon_coherence(spark, sf_dir):
    """Crossed quantiles, envelopes that narrow with the horizon, and changes of sign between neighbouring horizons."""
    order = W.partitionBy("origin_at", "model").orderBy("horizon")
    rows = scored(spark, sf_dir).where("predicted IS NOT NULL").withColumns({f"p_{c}": F.lag(c).over(order) for c in ("q10", "q90", "predicted_change_pct")})
    flip = (F.col("predicted_change_pct") * F.col("p_predicted_change_pct") < 0) & (F.abs(F.col("predicted_change_pct") - F.col("p_predicted_change_pct")) > 0.25)
    return rows.groupBy("model", "horizon").agg(F.count_if(F.col("q10") > F.col("q90")).alias("crossed"), F.count_if((F.col("q10") > F.col("p_q10")) | (F.col("q90") < F.col("p_q90"))).alias("narrowed"), F.count_if(flip).alias("flipped"))


@query(f"""WITH {SCORED} SELECT origin_at, horizon, model, round(abs_pct, 5) AS abs_pct FROM scored WHERE origin_at < TIMESTAMP '2024-01-20 05:00:00' OR (origin_at = TIMESTAMP '2024-01-20 05:00:00' AND (horizon > 4 OR (horizon = 4 AND model > 'drift'))) ORDER BY origin_at DESC, horizon, model LIMIT 51""")
def keyset_page(spark, sf_dir):
    """The page after a key, and one row that tells of the next."""
    at = F.to_timestamp_ntz(F.lit("2024-01-20 05:00:00"))
    page = evaluate.keyset_page(scored(spark, sf_dir), [("origin_at", True), ("horizon", False), ("model", False)], {"origin_at": at, "horizon": 4, "model": "drift"}, 50)
    return page.select("origin_at", "horizon", "model", F.round("abs_pct", 5).alias("abs_pct"))


@query(f"WITH {SCORED} SELECT model, horizon, round(predicted, 5) AS predicted, origin_at FROM scored WHERE origin_at = (SELECT max(origin_at) FROM scored)")
def latest_forecast(spark, sf_dir):
    rows = scored(spark, sf_dir)
    newest = F.rank().over(W.partitionBy("series").orderBy(F.desc("origin_at")))
    return rows.withColumn("k", newest).where("k = 1").select("model", "horizon", F.round("predicted", 5).alias("predicted"), "origin_at")


@query(f"""WITH {SCORED}, m AS (SELECT horizon, model, avg(abs_pct) AS mae FROM scored GROUP BY 1, 2) SELECT horizon, model, CAST(rank() OVER (PARTITION BY horizon ORDER BY CASE WHEN model = 'persistence' THEN 0 ELSE 1 END, mae NULLS LAST, model) AS INT) AS place, round(mae, 5) AS mae_pct FROM m""")
def leaderboard(spark, sf_dir):
    """The champion first, then candidates by error."""
    out = evaluate.summary(scored(spark, sf_dir), "horizon", "model")
    order = W.partitionBy("horizon").orderBy((F.col("model") != "persistence").cast("int"), F.asc_nulls_last("mae_pct"), "model")
    return out.select("horizon", "model", F.rank().over(order).alias("place"), F.round("mae_pct", 5).alias("mae_pct"))


@query(f"WITH {SCORED}, {SCORE}, r AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY score DESC, model) AS place FROM scores) SELECT horizon, model, CAST(place AS INT) AS place, round(score, 6) AS score FROM r WHERE place <= 3")
def top_contributors(spark, sf_dir):
    out = evaluate.adaptive_scores(scored(spark, sf_dir), "horizon", "model")
    place = F.row_number().over(W.partitionBy("horizon").orderBy(F.desc("score"), "model"))
    return out.withColumn("place", place).where("place <= 3").select("horizon", "model", "place", r6("score").alias("score"))


@query(f"""WITH {SCORED}, g AS (SELECT *, (epoch({NOW}) - epoch(target_at)) / 3600 AS age FROM scored WHERE actual IS NOT NULL)
SELECT model, CASE WHEN age < 24 THEN '0-24' WHEN age < 96 THEN '24-96' WHEN age < 336 THEN '96-336' ELSE '336+' END AS band, {METRICS} FROM g GROUP BY 1, 2""")
def age_bands(spark, sf_dir):
    age = (F.unix_timestamp(now().cast("timestamp")) - F.unix_timestamp(F.col("target_at").cast("timestamp"))) / 3600
    band = F.when(age < 24, "0-24").when(age < 96, "24-96").when(age < 336, "96-336").otherwise("336+")
    return shown(evaluate.summary(scored(spark, sf_dir).where("actual IS NOT NULL").withColumn("band", band), "model", "band"), "model", "band")


@query(f"""WITH {FEATURES}, c AS (SELECT ts, ntile(5) OVER (ORDER BY ts) - 1 AS chunk FROM bars), s AS (SELECT chunk AS fold, min(ts) AS start FROM c WHERE chunk > 0 GROUP BY 1), t AS (SELECT fold, 'train' AS role, b.ts FROM bars b JOIN s ON b.ts <= s.start - INTERVAL 24 HOUR),
u AS (SELECT fold, role, ts FROM t UNION ALL SELECT chunk, 'validate', ts FROM c WHERE chunk > 0) SELECT CAST(fold AS INT) AS fold, role, count(*) AS rows, min(ts) AS first_at, max(ts) AS last_at FROM u WHERE fold IN (SELECT fold FROM t GROUP BY 1 HAVING count(*) >= 50) GROUP BY 1, 2""")
def walk_forward_folds(spark, sf_dir):
    out = evaluate.folds(market(spark, sf_dir).select("series", "ts"), 4, 16, 8, 50)
    return out.groupBy(F.col("fold").cast("int").alias("fold"), "role").agg(F.count("*").alias("rows"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query()
def ema_returns(spark, sf_dir):
    return forecasts.ema_forecast(market(spark, sf_dir)).select("ts", F.round("ema", 8).alias("ema"))


@query()
def ar1_forecast(spark, sf_dir):
    out = forecasts.ar1_paths(market(spark, sf_dir))
    return out.select("ts", r6("phi").alias("phi"), r6(F.aggregate("path", F.lit(0.0), lambda a, r: a + r)).alias("return_16h"))


LINEAR = ["volatility_6h", "volatility_24h", "mean_range_24h", "volume_z", "rsi_14", "momentum_6h", "momentum_24h"]


def training(bars, names, horizons):
    """Features and returns of every origin whose target is known, for each horizon."""
    found = features.market_features(bars)
    each = [forecasts.training_rows(found, names, h).withColumn("horizon", F.lit(h)) for h in horizons]
    return reduce(DataFrame.unionByName, each)


def linear(spark, sf_dir, **how):
    designs = [moments.Design("all", tuple(LINEAR))]
    return moments.linear_replay(training(typed(spark, sf_dir), LINEAR, [8]), LINEAR, designs, least=100, **how).select("series", "ts", r6("prediction").alias("prediction"), r6("y").alias("y"))


@query()
def ridge_walk_forward(spark, sf_dir):
    """Ridge forecasts of every origin of each series, from sums over what was known by then."""
    return linear(spark, sf_dir, penalty=10.0)


@query()
def elastic_net_walk_forward(spark, sf_dir):
    """Elastic-net forecasts, fitted anew every day."""
    return linear(spark, sf_dir, penalty=1e-3, method="elastic", every_origin=False, part_hours=24)


@query()
def boosted_tree_forecast(spark, sf_dir):
    return forecasts.boosted_trees(training(market(spark, sf_dir), LINEAR, [8]).drop("horizon")).select("ts", r6("prediction").alias("prediction"), r6("y").alias("y"))
