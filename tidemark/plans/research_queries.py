"""Queries on regime detectors, experts, uncertainty, targets, recalibration and challengers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import drift, ensemble, evaluate, features, forecasts, inference, moments, specialists, store
from tidemark.plans.base import market, query, r6, table, typed
from tidemark.plans.candle_queries import FEATURES, NAMES, regimes
from tidemark.plans.drift_queries import windows_sql
from tidemark.plans.ensemble_queries import CONF, PRIORS, confidence_rows
from tidemark.plans.replay_queries import scored_typed
from tidemark.plans.forecast_queries import NOW, SCORE, SCORED, now, scored, training

OVER = "greatest(0, ({x} - {s}) / {w})".format
V6, V24, V7 = "greatest(volatility_6h, 1e-6)", "greatest(volatility_24h, 1e-6)", "greatest(volatility_168h, 1e-6)"
STATES = f"""{FEATURES}, st0 AS (SELECT *, {V24} / {V7} AS ratio, abs(momentum_6h) / greatest(0.2, {V6} * sqrt(6)) AS n6, abs(momentum_24h) / greatest(0.4, {V24} * sqrt(24)) AS n24,
  abs(momentum_168h) / greatest(1.0, {V7} * sqrt(168)) AS n7, abs(rsi_14 - 50) / 25 AS ext,
  CASE WHEN least(momentum_6h, momentum_24h, momentum_168h) > 0 OR greatest(momentum_6h, momentum_24h, momentum_168h) < 0 THEN 1 ELSE 0 END AS same FROM regimes), st1 AS (
  SELECT *, greatest(0.6 * {OVER(x='ratio', s=1.05, w=0.45)} + 0.25 * {OVER(x=f'{V6} / {V24}', s=1.05, w=0.55)} + 0.1 * {OVER(x=f'greatest(mean_range_24h, 0) / greatest({V24}, 0.05)', s=1.2, w=1.4)}
    + 0.05 * {OVER(x='abs(volume_z)', s=1.25, w=1)}, 0) AS wild, greatest(0.5 * n24 + 0.2 * n6 + 0.1 * n7 + 0.12 * same + 0.08 * ext, 0) AS trend,
  greatest(1 - least(0.7, 0.45 * greatest(0, ratio - 0.9)) - least(0.65, 0.4 * n24) - least(0.3, 0.15 * ext), 0) AS calm,
  least(3, ratio) AS p1, least(3, abs(momentum_24h) / greatest(0.5, {V24} * sqrt(24))) AS p2, least(2, ext) AS p3, least(3, abs(volume_z) / 2) AS p4 FROM st0), st2 AS (
  SELECT *, CASE WHEN wild >= 0.78 AND wild >= 0.92 * trend THEN 'high_volatility' WHEN trend >= 0.92 AND trend >= 0.9 * wild THEN 'trending' ELSE 'range' END AS validated, {{far}} FROM st1), states AS (
  SELECT *, CASE WHEN far_range <= far_trending AND far_range <= far_high_volatility THEN 'range' WHEN far_trending <= far_high_volatility THEN 'trending' ELSE 'high_volatility' END AS prototype FROM st2)""".replace(
    "{far}", ", ".join(" + ".join(f"power((p{k + 1} - {c}) / {s}, 2)" for k, (c, s) in enumerate(zip(centre, specialists.SCALES))) + f" AS far_{name}" for name, centre in specialists.CENTRES.items())
)


def states(spark, sf_dir):
    found = regimes(spark, sf_dir).withColumns(specialists.regime_scores())
    return found.withColumns({"validated": specialists.validated_regime(F.col("trending"), F.col("high_volatility")), "prototype": specialists.prototype_regime()})


@query(f"WITH {STATES} SELECT ts, round(calm, 4) AS range_score, round(trend, 4) AS trend_score, round(wild, 4) AS high_score, validated, prototype FROM states")
def regime_states(spark, sf_dir):
    """Scores of three states, and two detectors from them and from fixed centres."""
    shown = {"range_score": "range", "trend_score": "trending", "high_score": "high_volatility"}
    return states(spark, sf_dir).select("ts", *[F.round(c, 4).alias(n) for n, c in shown.items()], "validated", "prototype")


@query(f"WITH {STATES} SELECT regime AS heuristic, validated, prototype, count(*) AS origins FROM states GROUP BY 1, 2, 3")
def detector_comparison(spark, sf_dir):
    """How three detectors label the same origins."""
    return states(spark, sf_dir).groupBy(F.col("regime").alias("heuristic"), "validated", "prototype").agg(F.count("*").alias("origins"))


@query(f"""WITH {FEATURES}, r AS (SELECT *, abs(momentum_24h) > greatest(1, volatility_24h * sqrt(24) * 1.2) AS mo, rsi_14 >= 70 OR rsi_14 <= 30 AS st FROM regimes)
SELECT regime, CASE WHEN regime = 'high_volatility' THEN 'volatility' WHEN mo AND st THEN 'momentum and strength' WHEN mo THEN 'momentum' WHEN st THEN 'strength' ELSE 'none' END AS rule, count(*) AS origins FROM r GROUP BY 1, 2""")
def regime_explanations(spark, sf_dir):
    """Which rule gave each origin its regime."""
    return regimes(spark, sf_dir).groupBy("regime", specialists.regime_rule().alias("rule")).agg(F.count("*").alias("origins"))


def score_sql(by: str) -> str:
    return f"""SELECT {by}, count(*) AS n, exp(-2.5 * avg(abs_pct) / 100) * (1 + 0.25 * (avg(direction_correct) - 0.5) * 2) * exp(-0.35 * abs(avg(signed_pct)) / 100)
  * CASE WHEN count(within) >= 3 THEN exp(-0.35 * abs(avg(CAST(within AS INT)) - 0.8)) ELSE 1 END AS score FROM scored WHERE actual IS NOT NULL GROUP BY {by}"""


@query(f"""WITH {SCORED}, own AS ({score_sql("horizon, regime, model")}), whole AS ({score_sql("horizon, model")}), rg AS (SELECT DISTINCT horizon, regime FROM scored), e AS (
SELECT rg.horizon, rg.regime, w.model, o.score AS own, w.score AS everywhere, min(coalesce(o.n, 0)) OVER (PARTITION BY rg.horizon, rg.regime) < 40 AS sparse FROM rg JOIN whole w ON w.horizon = rg.horizon
LEFT JOIN own o ON o.horizon = rg.horizon AND o.regime = rg.regime AND o.model = w.model), v AS (SELECT *, CASE WHEN sparse THEN everywhere ELSE own END AS s FROM e)
SELECT horizon, regime, CASE WHEN sparse THEN 'fallback' ELSE regime END AS expert, model, round(s / sum(s) OVER (PARTITION BY horizon, regime), 6) AS share FROM v""")
def expert_weights(spark, sf_dir):
    """Weights by the expert of each regime, or of all where samples are few."""
    out = specialists.expert_weights(scored(spark, sf_dir), 40, "horizon")
    return out.select("horizon", "regime", "expert", "model", r6("share").alias("share"))


UNSURE = """un0 AS (SELECT *, row_number() OVER (PARTITION BY model, horizon ORDER BY origin_at DESC) AS k FROM scored WHERE actual IS NOT NULL AND q90 > q10 AND predicted > 0), un1 AS (
SELECT model, horizon, count(*) AS samples, avg(CAST(within AS INT)) AS coverage, avg((q90 - q10) / predicted * 100) AS width_pct FROM un0 WHERE k <= 50 GROUP BY 1, 2), unsure AS (
SELECT *, abs(coverage - 0.8) AS coverage_error, samples >= 12 AND coverage < 0.7 AS overconfident, CASE WHEN samples >= 12 THEN 'calibrated' ELSE 'sparse_fallback' END AS state FROM un1)"""


@query(f"WITH {SCORED}, {UNSURE} SELECT model, horizon, samples, round(coverage, 6) AS coverage, round(coverage_error, 6) AS coverage_error, round(width_pct, 4) AS width_pct, CAST(overconfident AS INT) AS overconfident, state FROM unsure")
def calibrated_uncertainty(spark, sf_dir):
    """Coverage and width of the newest fifty intervals of each model."""
    out = specialists.calibrated_uncertainty(scored(spark, sf_dir), 50, "model", "horizon")
    return out.select("model", "horizon", "samples", r6("coverage").alias("coverage"), r6("coverage_error").alias("coverage_error"), F.round("width_pct", 4).alias("width_pct"), F.col("overconfident").cast("int").alias("overconfident"), "state")


@query(f"""WITH {SCORED}, {SCORE}, {UNSURE}, p AS (SELECT model, horizon, CASE WHEN state = 'calibrated' THEN 1 - 0.7 * least(1, greatest(0, (samples - 12) / 48)) * (1 - exp(-2 * coverage_error)) ELSE 1 END AS penalty FROM unsure)
SELECT horizon, model, round(penalty, 6) AS penalty, round(score * penalty / sum(score * penalty) OVER (PARTITION BY horizon), 6) AS share FROM scores JOIN p USING (model, horizon)""")
def uncertainty_weights(spark, sf_dir):
    """Adaptive weights, less where intervals were off."""
    from pyspark.sql import Window as W

    rows = scored(spark, sf_dir)
    penalty = specialists.calibrated_uncertainty(rows, 50, "model", "horizon").select("model", "horizon", specialists.uncertainty_penalty().alias("penalty"))
    out = evaluate.adaptive_scores(rows, "horizon", "model").join(penalty, ["horizon", "model"]).withColumn("w", F.col("score") * F.col("penalty"))
    return out.select("horizon", "model", r6("penalty").alias("penalty"), r6(F.col("w") / F.sum("w").over(W.partitionBy("horizon"))).alias("share"))


@query("""WITH w AS (SELECT c_mktsegment AS g, CAST(c_nationkey AS VARCHAR) AS model, greatest(sum(c_acctbal), 0) AS w FROM customer GROUP BY 1, 2), r AS (
SELECT *, row_number() OVER o AS nth, sum(w) OVER (PARTITION BY g ORDER BY w DESC, model ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, count(CASE WHEN w > 0 THEN 1 END) OVER (PARTITION BY g) AS n
FROM w WINDOW o AS (PARTITION BY g ORDER BY w DESC, model)), f AS (SELECT g, min(nth) AS k FROM r WHERE w > 0 AND w * (1 - 0.08 * (nth - 1)) <= 0.08 * rest * (1 + 1e-12) GROUP BY 1), x AS (
SELECT r.*, f.k, t.rest AS frest FROM r LEFT JOIN f USING (g) LEFT JOIN r t ON t.g = r.g AND t.nth = f.k)
SELECT g AS segment, model, round(CASE WHEN n * 0.08 < 1 - 1e-12 THEN NULL WHEN k IS NULL OR nth < k THEN CASE WHEN w > 0 THEN 0.08 ELSE 0 END ELSE w * (1 - 0.08 * (k - 1)) / frest END, 6) AS share FROM x""")
def capped_weights(spark, sf_dir):
    """Shares of balances by nation, none above a cap, in each market segment."""
    w = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("model")).agg(F.greatest(F.sum("c_acctbal"), F.lit(0.0)).alias("w"))
    return specialists.capped_shares(w, "w", 0.08, "segment").select("segment", "model", r6("share").alias("share"))


RESERVED = specialists.reserved_prior(PRIORS, "ridge", 0.5)


@query(f"WITH p(model, w) AS (VALUES {', '.join(f'({m!r}, {w!r}::DOUBLE)' for m, w in PRIORS.items())}) SELECT model, round(0.8 * w / (SELECT sum(w) FROM p), 6) AS weight FROM p UNION ALL SELECT 'ridge', 0.2")
def reserved_prior(spark, sf_dir):
    """The static prior with a share kept for one more model, bounded to a fifth."""
    return spark.createDataFrame(sorted(RESERVED.items()), "model string, weight double").select("model", r6("weight").alias("weight"))


TARGET_SQL = {"log_return": ("ln({p} / source_price)", "exp"), "price_ratio": ("{p} / source_price", ""), "log_price": ("ln({p})", "")}


@query(
    f"WITH {SCORED}, k AS (SELECT * FROM scored WHERE actual > 0 AND source_price > 0), f AS (SELECT *, CASE WHEN predicted > 0 THEN predicted END AS p FROM k) "
    + " UNION ALL ".join(
        f"SELECT horizon, '{t}' AS target, count(p) AS scored, count(*) - count(p) AS failures, round(avg(abs(ln(p / source_price) - ln(actual / source_price))), 6) AS return_error, "
        f"round(avg(abs({e.format(p='p')} - {e.format(p='actual')})), 6) AS target_error, round(avg(abs(p - actual) / actual * 100), 4) AS price_ape, 1 AS inverts FROM f GROUP BY 1"
        for t, (e, _) in TARGET_SQL.items()
    )
)
def target_experiment(spark, sf_dir):
    """Errors of the same forecasts as three labels."""
    out = specialists.target_losses(scored(spark, sf_dir), "horizon")
    return out.select("horizon", "target", "scored", "failures", r6("return_error").alias("return_error"), r6("target_error").alias("target_error"), F.round("price_ape", 4).alias("price_ape"), F.col("inverts").cast("int").alias("inverts"))


CLASS = "CASE WHEN {c} > {t} THEN 'up' WHEN {c} < -{t} THEN 'down' ELSE 'neutral' END".format


@query(f"""WITH {SCORED}, c AS (SELECT model, horizon, {CLASS(c='actual_change_pct', t=0.25)} AS f, {CLASS(c='actual_change_pct', t=40)} AS l, {CLASS(c='predicted_change_pct', t=40)} AS s FROM scored WHERE actual_change_pct IS NOT NULL AND predicted_change_pct IS NOT NULL)
SELECT model, horizon, count(*) AS samples, round(avg(CAST(f = 'neutral' AS INT)), 6) AS fixed_neutral, round(avg(CAST(l = 'neutral' AS INT)), 6) AS learned_neutral, round(avg(CAST(f = l AS INT)), 6) AS agreement,
CAST(count_if(f <> 'neutral' AND l = 'neutral') AS BIGINT) AS to_neutral, CAST(count_if(f = 'neutral' AND l <> 'neutral') AS BIGINT) AS to_directional, round(avg(CAST(s = f AS INT)), 6) AS fixed_accuracy, round(avg(CAST(s = l AS INT)), 6) AS learned_accuracy FROM c GROUP BY 1, 2""")
def threshold_reclassification(spark, sf_dir):
    """What a wider neutral band changes on the same outcomes."""
    out = specialists.reclassified(scored(spark, sf_dir), 40, 0.25, "model", "horizon")
    return out.select("model", "horizon", "samples", "to_neutral", "to_directional", *[r6(c).alias(c) for c in ("fixed_neutral", "learned_neutral", "agreement", "fixed_accuracy", "learned_accuracy")])


EVIDENCE = f"""{SCORED}, ev AS (SELECT model, horizon, count(*) AS samples, avg(CAST(within AS INT)) AS coverage, count(direction_correct) AS hits, avg(direction_correct) AS hit_rate, 1.0 AS before,
  greatest(least(sqrt(0.8 / greatest(avg(CAST(within AS INT)), 0.1)), 1.75), 0.75) AS recommended FROM scored WHERE actual IS NOT NULL AND q10 IS NOT NULL GROUP BY 1, 2), rc AS (
SELECT *, CASE WHEN NOT (abs(coverage - 0.8) > 0.05 + 1e-9 AND samples >= 20) THEN 'kept' WHEN abs(before - recommended) / before > 0.5 THEN 'unsafe_change' ELSE 'applied' END AS status FROM ev), ra AS (
SELECT *, CASE WHEN status = 'applied' THEN greatest(0.9, least(recommended, 1.1)) ELSE before END AS after, (CASE WHEN hits >= 20 AND hit_rate < 0.45 THEN 1 ELSE 0 END) + (CASE WHEN status = 'unsafe_change' THEN 1 ELSE 0 END) AS alerts FROM rc)"""


def recalibrated(spark, sf_dir):
    share = F.avg(F.col("within").cast("int"))
    recommended = F.greatest(F.least(F.sqrt(0.8 / F.greatest(share, F.lit(0.1))), F.lit(1.75)), F.lit(0.75))
    evidence = scored(spark, sf_dir).where("actual IS NOT NULL AND q10 IS NOT NULL").groupBy("model", "horizon").agg(
        F.count("*").alias("samples"), share.alias("coverage"), F.count("direction_correct").alias("hits"), F.avg("direction_correct").alias("hit_rate"), F.lit(1.0).alias("before"), recommended.alias("recommended")
    )
    return specialists.recalibration(evidence)


@query(f"WITH {EVIDENCE} SELECT model, horizon, status, round(recommended, 6) AS recommended, round(after, 6) AS after, CAST(alerts AS INT) AS alerts FROM ra")
def recalibration_proposals(spark, sf_dir):
    """Bounded changes of interval multipliers, and why others are not made."""
    return recalibrated(spark, sf_dir).select("model", "horizon", "status", r6("recommended").alias("recommended"), r6("after").alias("after"), F.size("alerts").alias("alerts"))


@query(f"WITH {EVIDENCE} SELECT model || '/' || horizon AS id, round(CASE WHEN status = 'applied' THEN before ELSE after END, 6) AS multiplier FROM ra")
def recalibration_rollback(spark, sf_dir):
    """The multipliers once the last applied change is undone."""
    ident = F.concat_ws("/", "model", F.col("horizon").cast("string"))
    made = recalibrated(spark, sf_dir).withColumn("id", ident)
    log = made.select(F.lit(2).alias("at"), "id", "status", "before").unionByName(made.select(F.lit(1).alias("at"), "id", F.lit("applied").alias("status"), F.lit(0.5).alias("before")))
    return specialists.rolled_back(made.select("id", F.col("after").alias("multiplier")), log, "id").select("id", r6("multiplier").alias("multiplier"))


@query(f"WITH {CONF} SELECT count(*) AS horizons, round(min(score), 4) AS score, CASE WHEN min(score) >= 70 THEN 'high' WHEN min(score) >= 45 THEN 'moderate' ELSE 'low' END AS band, round(min(skill) * 100, 4) AS least_skill_pct FROM cf")
def overall_confidence(spark, sf_dir):
    """The weakest horizon bounds the whole."""
    return confidence_rows(spark, sf_dir).agg(F.count("*").alias("horizons"), F.round(F.min("score"), 4).alias("score"), ensemble.confidence_band(F.min("score")).alias("band"), F.round(F.min("skill") * 100, 4).alias("least_skill_pct"))


@query(f"""WITH {SCORED}, o AS (SELECT *, least(q10, predicted - source_price * 0.0005) AS lo, greatest(q90, predicted + source_price * 0.0005) AS hi FROM scored WHERE predicted IS NOT NULL), c AS (
SELECT *, min(least(lo, hi)) OVER w AS low, max(greatest(lo, hi)) OVER w AS high FROM o WINDOW w AS (PARTITION BY origin_at, model ORDER BY horizon)), d AS (
SELECT *, low > lag(low) OVER w OR high < lag(high) OVER w AS narrower FROM c WINDOW w AS (PARTITION BY origin_at, model ORDER BY horizon))
SELECT count(*) AS rows, CAST(count_if(low > predicted OR predicted > high) AS BIGINT) AS crossing, CAST(count_if(narrower) AS BIGINT) AS narrowing FROM d""")
def coherence_assertion(spark, sf_dir):
    """What is still incoherent once intervals are made coherent: nothing, or the run must stop."""
    from pyspark.sql import Window as W

    w = W.partitionBy("series", "origin_at", "model").orderBy("horizon")
    rows = ensemble.coherent(scored(spark, sf_dir).where("predicted IS NOT NULL"), 0.05, "series", "origin_at", "model")
    rows = rows.withColumn("narrower", (F.col("low") > F.lag("low").over(w)) | (F.col("high") < F.lag("high").over(w)))
    return rows.agg(F.count("*").alias("rows"), F.count_if((F.col("low") > F.col("predicted")) | (F.col("predicted") > F.col("high"))).alias("crossing"), F.count_if("narrower").alias("narrowing"))


@query(f"""WITH {SCORED}, s AS (SELECT *, CASE WHEN hour(origin_at) = 7 THEN abs_pct + 1 WHEN hour(origin_at) = 9 THEN NULL ELSE abs_pct END AS stored FROM scored WHERE actual IS NOT NULL)
SELECT model, count(*) AS rows, CAST(count_if(stored IS DISTINCT FROM abs_pct AND (stored IS NULL OR abs_pct IS NULL OR abs(stored - abs_pct) > 1e-6)) AS BIGINT) AS repaired, round(avg(abs_pct), 5) AS mae_pct FROM s GROUP BY 1""")
def repaired_outcomes(spark, sf_dir):
    """Stored errors that are wrong or missing, put right from the outcome."""
    rows = scored(spark, sf_dir).where("actual IS NOT NULL")
    stored = rows.withColumn("stored", F.when(F.hour("origin_at") == 7, F.col("abs_pct") + 1).when(F.hour("origin_at") == 9, F.lit(None)).otherwise(F.col("abs_pct")))
    out = store.repaired(stored, {"stored": F.col("abs_pct")})
    return out.groupBy("model").agg(F.count("*").alias("rows"), F.count_if("repaired").alias("repaired"), F.round(F.avg("stored"), 5).alias("mae_pct"))


@query(f"""WITH {SCORED}, o AS (SELECT horizon, model, avg(abs_pct) AS objective FROM scored WHERE abs_pct IS NOT NULL GROUP BY 1, 2), c AS (SELECT horizon, arg_min(model, objective) FILTER (model <> 'persistence') AS best, min(objective) FILTER (model <> 'persistence') AS least, max(objective) FILTER (model = 'persistence') AS kept FROM o GROUP BY 1)
SELECT horizon, CASE WHEN 1 - least / kept > 0.02 THEN best ELSE 'persistence' END AS chosen, round(1 - least / kept, 6) AS gain FROM c""")
def candidate_choice(spark, sf_dir):
    """The candidate with the least error, if it clearly beats the one in use."""
    objective = scored(spark, sf_dir).groupBy("horizon", "model").agg(F.avg("abs_pct").alias("objective"))
    other, mine = F.when(F.col("model") != "persistence", F.col("objective")), F.when(F.col("model") == "persistence", F.col("objective"))
    out = objective.groupBy("horizon").agg(F.min(F.struct(other.isNull(), other, "model"))["model"].alias("best"), (1 - F.min(other) / F.max(mine)).alias("gain"))
    return out.select("horizon", F.when(F.col("gain") > 0.02, F.col("best")).otherwise("persistence").alias("chosen"), r6("gain").alias("gain"))


SHADOW = f"""{SCORED}, sb AS (SELECT series, origin_at, horizon, abs_pct FROM scored WHERE model = 'persistence' AND predicted IS NOT NULL AND actual IS NOT NULL AND target_at <= {NOW}), sh AS (
SELECT s.model, s.horizon, count(*) AS attempts, CAST(count_if(s.predicted IS NULL) AS BIGINT) AS failures, CAST(count_if(s.predicted IS NOT NULL AND s.actual IS NOT NULL AND s.target_at <= {NOW}) AS BIGINT) AS matured,
  CAST(count_if(s.predicted IS NOT NULL AND s.actual IS NOT NULL AND s.target_at <= {NOW} AND b.origin_at IS NOT NULL) AS BIGINT) AS paired, min(s.origin_at) AS first_at, max(s.origin_at) AS last_at
FROM scored s LEFT JOIN sb b USING (series, origin_at, horizon) GROUP BY 1, 2), gn AS (
SELECT s.model, s.horizon, s.origin_at, b.abs_pct - s.abs_pct AS gain FROM scored s JOIN sb b USING (series, origin_at, horizon) WHERE s.model <> 'persistence' AND s.abs_pct IS NOT NULL AND b.abs_pct IS NOT NULL), go AS (
SELECT *, gain - avg(gain) OVER (PARTITION BY model, horizon) AS off FROM gn), gl AS (SELECT *, {', '.join(f'off * lag(off, {k}) OVER w AS c{k}' for k in range(1, 9))} FROM go WINDOW w AS (PARTITION BY model, horizon ORDER BY origin_at)), sg AS (
SELECT model, horizon, count(*) AS pairs, avg(gain) AS mean_gain, sum(off * off) / count(*) AS own, ({' + '.join(f'2 * (1 - {k} / 9) * coalesce(sum(c{k}), 0)' for k in range(1, 9))}) / count(*) AS rest FROM gl GROUP BY 1, 2), sz AS (
SELECT model, horizon, pairs, mean_gain, mean_gain / nullif(sqrt(greatest(own + rest, own) / pairs), 0) AS z FROM sg)"""


def shadow(spark, sf_dir):
    """Evidence of each challenger, and how sure its gains over persistence are."""
    rows = scored(spark, sf_dir)
    evidence = specialists.evidence_report(rows, "persistence", now(), "horizon")
    key = ["series", "origin_at", "horizon"]
    base = rows.where("model = 'persistence' AND predicted IS NOT NULL AND actual IS NOT NULL").where(F.col("target_at") <= now()).select(*key, F.col("abs_pct").alias("base"))
    gains = rows.where("model <> 'persistence'").join(base, key).withColumn("gain", F.col("base") - F.col("abs_pct"))
    return evidence, inference.long_run_z(gains, "gain", 8, "origin_at", "model", "horizon")


@query(f"WITH {SHADOW} SELECT * FROM sh")
def evidence_report(spark, sf_dir):
    """Attempts, failures, matured and paired forecasts of every configuration."""
    return shadow(spark, sf_dir)[0].select("model", "horizon", "attempts", "failures", "matured", "paired", "first_at", "last_at")


@query(f"WITH {SHADOW} SELECT model, horizon, pairs, round(mean_gain, 5) AS mean_gain, round(z, 4) AS z FROM sz")
def paired_significance(spark, sf_dir):
    """Mean gains over persistence in units of their long-run error."""
    return shadow(spark, sf_dir)[1].select("model", "horizon", "pairs", F.round("mean_gain", 5).alias("mean_gain"), F.round("z", 4).alias("z"))


@query(f"""WITH {SHADOW}, ck AS (SELECT model, horizon, paired >= 100 AS a, date_diff('day', CAST(first_at AS DATE), CAST(last_at AS DATE)) >= 14 AS b, coalesce(z > 1.96, FALSE) AS c, coalesce(z > -1.96, FALSE) AS d FROM sh LEFT JOIN sz USING (model, horizon) WHERE model <> 'persistence'), al AS (
SELECT model, count(*) AS horizons, bool_and(a) AS a, bool_and(b) AS b, bool_and(c) AS c, bool_and(d) AS d FROM ck GROUP BY 1)
SELECT model, horizons, CASE WHEN NOT d THEN 'reject' WHEN NOT a OR NOT b THEN 'collect_more' WHEN c THEN 'promote' ELSE 'hold' END AS decision,
concat_ws(',', CASE WHEN NOT a THEN 'pairs' END, CASE WHEN NOT b THEN 'days' END, CASE WHEN NOT c THEN 'gain' END, CASE WHEN NOT d THEN 'no_loss' END) AS blocked FROM al""")
def shadow_evaluation(spark, sf_dir):
    """Which challengers would be promoted, and what keeps the others back."""
    evidence, significance = shadow(spark, sf_dir)
    return specialists.shadow_gate(evidence.where("model <> 'persistence'"), significance, 100, 14)


@query(f"WITH {SCORED} SELECT strftime(origin_at, '%Y-%m-%d %H:%M:%S') || '/' || model || '/' || horizon AS attempt_id, 'no_outcome' AS error FROM scored WHERE actual IS NULL AND hour(origin_at) <> 3")
def failure_ledger(spark, sf_dir):
    """Attempts without an outcome that the ledger doesn't have yet."""
    failed = scored(spark, sf_dir).where("actual IS NULL")
    rows = failed.select(F.concat_ws("/", F.date_format("origin_at", "yyyy-MM-dd HH:mm:ss"), "model", F.col("horizon").cast("string")).alias("attempt_id"), F.lit("no_outcome").alias("error"), "origin_at")
    return store.first_writes(rows, rows.where(F.hour("origin_at") == 3), ["attempt_id"], [F.col("origin_at")]).select("attempt_id", "error")


@query(f"""WITH {SCORED}, g AS (SELECT origin_at, model, horizon FROM (SELECT DISTINCT origin_at FROM scored), (VALUES ('persistence'), ('drift'), ('seasonal')) m(model), (VALUES (2), (4), (8), (16), (24)) h(horizon))
SELECT model, horizon, count(*) AS attempts, count(s.predicted) AS made, CAST(count_if(s.predicted IS NULL) AS BIGINT) AS failed FROM g LEFT JOIN scored s USING (origin_at, model, horizon) GROUP BY 1, 2""")
def baseline_attempts(spark, sf_dir):
    """Every baseline's attempt at every origin and horizon, made or failed."""
    rows = scored(spark, sf_dir)
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(h).alias("horizon")) for m in ("persistence", "drift", "seasonal") for h in (2, 4, 8, 16, 24)]))
    grid = rows.select("series", "origin_at").distinct().select("series", "origin_at", cells.alias("c")).select("series", "origin_at", "c.*")
    out = grid.join(rows.select("series", "origin_at", "model", "horizon", "predicted"), ["series", "origin_at", "model", "horizon"], "left")
    return out.groupBy("model", "horizon").agg(F.count("*").alias("attempts"), F.count("predicted").alias("made"), F.count_if(F.col("predicted").isNull()).alias("failed"))


FOLDS = """{p}c AS (SELECT g, ts, ntile({n}) OVER (PARTITION BY g ORDER BY ts) - 1 AS chunk FROM {src}), {p}s AS (SELECT g, chunk AS fold, min(ts) AS start FROM {p}c WHERE chunk > 0 GROUP BY 1, 2),
{p}t AS (SELECT fold, 'train' AS role, b.g, b.ts FROM {src} b JOIN {p}s s ON s.g = b.g AND b.ts <= s.start - INTERVAL 24 HOUR), {p}u AS (SELECT * FROM {p}t UNION ALL SELECT chunk, 'validate', g, ts FROM {p}c WHERE chunk > 0),
{p}f AS (SELECT * FROM {p}u WHERE (fold, g) IN (SELECT (fold, g) FROM {p}t GROUP BY fold, g HAVING count(*) >= {least}))""".format


@query(f"""WITH {FEATURES}, src AS (SELECT 'all' AS g, ts FROM bars), {FOLDS(p='outer_', n=4, src='src', least=50)}, train_ AS (SELECT 'all/' || fold AS g, ts FROM outer_f WHERE role = 'train'), {FOLDS(p='inner_', n=3, src='train_', least=20)}
SELECT CAST(string_split(g, '/')[2] AS INT) AS outer_fold, CAST(fold AS INT) AS inner_fold, role, count(*) AS rows, min(ts) AS first_at, max(ts) AS last_at FROM inner_f GROUP BY 1, 2, 3""")
def nested_folds(spark, sf_dir):
    """Folds within the training rows of each outer fold."""
    out = evaluate.nested_folds(market(spark, sf_dir).select("series", "ts"), (3, 2), 16, 8, (50, 20))
    return out.groupBy("outer_fold", "inner_fold", "role").agg(F.count("*").alias("rows"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("SELECT o_orderpriority AS family, count(*) AS raw_count, least(count(*), 300) AS comparisons, CAST(count(*) > 300 AS INT) AS truncated, round(0.05 / least(count(*), 300), 9) AS alpha FROM orders GROUP BY 1")
def family_sizes(spark, sf_dir):
    """How many comparisons of each family count, under the policy's cap, and at which level each is tested."""
    raw = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("family")).agg(F.count("*").alias("raw_count"))
    out = raw.withColumns({"comparisons": F.least("raw_count", F.lit(300)), "truncated": (F.col("raw_count") > 300).cast("int")})
    return out.withColumn("alpha", F.round(0.05 / F.col("comparisons"), 9))


POISSON_SQL = " + ".join(f"CAST(u >= {p!r} AS INT)" for p in inference.POISSON)


@query(f"""WITH e AS (SELECT event_id, event_type, value FROM events WHERE event_type IN ('purchase', 'click') AND value IS NOT NULL), b AS (
SELECT event_type, value, i, CAST('0x' || substr(md5(event_id || ':' || i), 1, 8) AS UBIGINT) / 4294967296.0::DOUBLE AS u FROM e, range(1, 41) t(i)), w AS (SELECT *, {POISSON_SQL} AS w FROM b), d AS (
SELECT i, sum(w * value) FILTER (event_type = 'purchase') / sum(w) FILTER (event_type = 'purchase') - sum(w * value) FILTER (event_type = 'click') / sum(w) FILTER (event_type = 'click') AS diff,
count(*) FILTER (event_type = 'purchase') AS a, count(*) FILTER (event_type = 'click') AS c FROM w GROUP BY 1), o AS (
SELECT max(a) AS n_one, max(c) AS n_other, avg(diff) AS difference, quantile_cont(diff, 0.025) AS low, quantile_cont(diff, 0.975) AS high, avg(CAST(diff < 0 AS INT)) AS p FROM d)
SELECT n_one, n_other, round(difference, 5) AS difference, round(low, 5) AS low, round(high, 5) AS high, round(p, 6) AS p_better, CASE WHEN least(n_one, n_other) < 20 THEN 'insufficient' WHEN high < 0 THEN 'better' WHEN low > 0 THEN 'worse' ELSE 'inconclusive' END AS conclusion FROM o""")
def unpaired_bootstrap(spark, sf_dir):
    """Means of two independent groups by forty Poisson samples."""
    out = inference.unpaired_bootstrap(table(spark, sf_dir, "events"), "value", "event_type", "event_id", "purchase", "click", 40)
    return out.select("n_one", "n_other", *[F.round(c, 5).alias(c) for c in ("difference", "low", "high")], r6("p_better").alias("p_better"), "conclusion")


@query(f"""WITH r(name, version, source) AS (VALUES {', '.join(f"('{n}', 1, 'candles')" for n in NAMES)}), s AS (SELECT string_agg(name || ':' || version || ':' || source, ',' ORDER BY name) AS lineage, count(*) AS features FROM r WHERE name LIKE 'volatility%' OR name LIKE 'momentum%')
SELECT features, lineage, sha256(lineage) AS feature_set FROM s""")
def feature_registry(spark, sf_dir):
    """The lineage of a set of features and its digest; a name that isn't registered raises."""
    registry = spark.createDataFrame([(n, 1, "candles") for n in NAMES], "name string, version int, source string")
    wanted = [n for n in NAMES if n.startswith(("volatility", "momentum"))]
    return store.resolved_features(registry, wanted)


CUTOFFS = ("2024-01-10", "2024-01-16", "2024-01-22", "2024-01-28")
STATE_ROWS = f"""SELECT cutoff, model, horizon, k, v FROM (SELECT c.cutoff, model, horizon, abs_pct AS v, row_number() OVER (PARTITION BY c.cutoff, model, horizon ORDER BY target_at DESC) AS k
  FROM scored JOIN (VALUES {', '.join(f"('{c}')" for c in CUTOFFS)}) c(cutoff) ON target_at <= CAST(c.cutoff AS TIMESTAMP) WHERE abs_pct IS NOT NULL) WHERE k <= 32"""


@query(f"WITH {SCORED}, {windows_sql(STATE_ROWS, 'cutoff, model, horizon', 8, 24)} SELECT cutoff, model, horizon, round(shift, 4) AS shift, ks, CASE grade WHEN 2 THEN 'severe' WHEN 1 THEN 'warning' ELSE 'none' END AS state FROM g")
def drift_states(spark, sf_dir):
    """Drift of absolute errors as it could be seen at four given times."""
    rows = scored(spark, sf_dir).where("abs_pct IS NOT NULL").select("model", "horizon", "target_at", "abs_pct", F.explode(F.array(*[F.lit(c) for c in CUTOFFS])).alias("cutoff"))
    seen = rows.where(F.col("target_at") <= F.to_timestamp_ntz("cutoff"))
    out = drift.two_windows(seen, "abs_pct", "target_at", 8, 24, "cutoff", "model", "horizon")
    return out.select("cutoff", "model", "horizon", F.round("shift", 4).alias("shift"), "ks", drift.severity(drift.distribution_grade(drift.Thresholds())).alias("state"))


ABLATED = [n for n in NAMES if n != "momentum_168h"]
ABLATIONS = {"momentum": "momentum", "volatility": "volatility", "volume": "volume", "range": "mean_range", "strength": "rsi"}


@query()
def feature_ablation(spark, sf_dir):
    """What each family of features adds to a ridge model: paired errors with and without it, all from the same sums."""
    designs = [moments.Design("all", tuple(ABLATED)), *[moments.Design(family, tuple(n for n in ABLATED if not n.startswith(start))) for family, start in ABLATIONS.items()]]
    report = moments.interaction_report(moments.linear_replay(training(typed(spark, sf_dir), ABLATED, [8]), ABLATED, designs, 10.0, 100), "all")
    keep = F.when(F.col("z") < -1.96, "keep").when(F.col("z") > 1.96, "drop").otherwise("unsure")
    return report.select("series", F.col("design").alias("family"), "pairs", (-F.round("mean_gain", 6)).alias("mean_gain"), (-F.round("z", 3)).alias("z"), keep.alias("recommendation"))


CROSSED = ["volatility_6h", "volatility_24h", "volatility_168h", "volume_z", "rsi_14", "momentum_6h", "momentum_24h", "trending"]
BASE = tuple(CROSSED[:-1])
INTERACTIONS = [
    moments.Interaction("volume_x_momentum", ("volume_z",), ("momentum_6h", "momentum_24h")),
    moments.Interaction("strength_x_volatility", ("rsi_14",), ("volatility_24h", "volatility_168h")),
    moments.Interaction("momentum_x_trend", ("momentum_6h", "momentum_24h"), gate="trending"),
]


def interactions(spark, sf_dir):
    bars = typed(spark, sf_dir)
    found = features.market_features(bars).withColumn("trending", (features.heuristic_regime() == "trending").cast("double"))
    each = [forecasts.training_rows(found, CROSSED, h).withColumn("horizon", F.lit(h)) for h in (2, 8, 16)]
    rows = reduce(DataFrame.unionByName, each)
    designs = [moments.Design("market", BASE), *[moments.Design(i.name, BASE, i) for i in INTERACTIONS]]
    return moments.interaction_report(moments.linear_replay(rows, CROSSED, designs, 1.0, 100), "market")


@query()
def interaction_evaluation(spark, sf_dir):
    """What interactions of features add to a ridge model at every horizon, and whether they would be promoted."""
    shown = [F.round(c, 6).alias(c) for c in ("baseline_mae", "candidate_mae", "relative_gain", "baseline_direction", "candidate_direction")]
    return interactions(spark, sf_dir).select("series", "horizon", "design", "pairs", *shown, F.round("z", 3).alias("z"), "folds", "improved", "stable", "status")


@query()
def interaction_overview(spark, sf_dir):
    """Of each interaction the gain over all horizons and the recommendation."""
    return moments.interaction_overall(interactions(spark, sf_dir)).withColumn("mean_gain", r6("mean_gain"))


def compared(spark, sf_dir, methods=inference.METHODS):
    """Paired errors of every model and persistence at the same origins, by series and horizon, resampled."""
    rows = scored_typed(spark, sf_dir).where("abs_pct IS NOT NULL")
    base = rows.where("model = 'persistence'").select("series", "horizon", "origin_at", F.col("abs_pct").alias("base"))
    pairs = rows.where("model <> 'persistence'").select("series", "horizon", "model", "origin_at", "abs_pct").join(base, ["series", "horizon", "origin_at"])
    return inference.bootstrap_comparisons(pairs, "abs_pct", "base", "origin_at", ["series", "horizon", "model"], methods, 500)


@query()
def bootstrap_methods(spark, sf_dir):
    """Three ways to resample the same paired errors, and what each concludes."""
    out = inference.concluded(compared(spark, sf_dir), "raw", F.lit(0.9))
    return out.select("series", "horizon", "model", "method", "samples", "block", *[F.round(c, 4).alias(c) for c in ("improvement", "effect", "correction", "raw_low", "raw_high", "p_better")], "raw_conclusion", "raw_reason")


@query()
def family_assessment(spark, sf_dir):
    """Every model against persistence at the plain level and at that of its rank among all models of the series and horizon."""
    out = inference.family_assessment(compared(spark, sf_dir, ["moving_block"]), ["series", "horizon"], "holm", 0.05)
    shown = [F.round(c, 6).alias(c) for c in ("p", "alpha", "adjusted_p", "raw_low", "raw_high", "adjusted_low", "adjusted_high")]
    return out.select("series", "horizon", "model", "samples", "comparisons", "rank", *shown, "raw_conclusion", "adjusted_conclusion", "survives", "selected")
