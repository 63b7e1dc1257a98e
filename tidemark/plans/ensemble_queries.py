"""Queries on weights, guards, coherence, confidence and decisions."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tidemark.operators import ensemble, evaluate
from tidemark.plans.base import query, r6, table
from tidemark.plans.forecast_queries import NOW, PAIRS, SCORE, SCORED, now, scored

FAMILY = {"persistence": "naive", "seasonal": "naive", "drift": "trend", "momentum": "trend", "blend": "blend"}
FAMILIES = {"naive": 2.0, "trend": 1.0, "blend": 3.0}
MODELS = sorted(FAMILY)
PRIORS = ensemble.static_priors(MODELS, FAMILIES, FAMILY)
PRIOR_SQL = "prior(model, weight) AS (VALUES " + ", ".join(f"('{m}', {w!r}::DOUBLE)" for m, w in PRIORS.items()) + ")"


def priors(spark):
    return spark.createDataFrame(list(PRIORS.items()), "model string, weight double")


@query(f"WITH {PRIOR_SQL} SELECT model, round(weight, 6) AS weight FROM prior")
def static_priors(spark, sf_dir):
    return priors(spark).select("model", r6("weight").alias("weight"))


@query(f"""WITH {SCORED}, {PRIOR_SQL}, b AS (SELECT origin_at, horizon, exp(sum(weight * ln(predicted)) / sum(weight)) AS price, greatest(avg(CAST(predicted - source_price > 0.005 AS INT)), avg(CAST(predicted - source_price < -0.005 AS INT)), avg(CAST(abs(predicted - source_price) <= 0.005 AS INT))) AS agreement FROM scored JOIN prior USING (model) WHERE predicted > 0 GROUP BY 1, 2)
SELECT b.origin_at, b.horizon, round(price, 5) AS price, round(agreement, 6) AS agreement, round(sqrt(greatest(sum(weight * power(predicted - price, 2)) / sum(weight), 0)), 3) AS dispersion FROM b JOIN scored s ON s.origin_at = b.origin_at AND s.horizon = b.horizon JOIN prior USING (model) WHERE predicted > 0 GROUP BY 1, 2, 3, 4""")
def weighted_ensemble(spark, sf_dir):
    """The geometric blend of every origin and horizon."""
    out = ensemble.blend(scored(spark, sf_dir).join(F.broadcast(priors(spark)), "model"), "weight", "origin_at", "horizon")  # a row for each model
    return out.select("origin_at", "horizon", F.round("price", 5).alias("price"), r6("agreement").alias("agreement"), F.round("dispersion", 3).alias("dispersion"))


@query(f"""WITH {SCORED}, {PRIOR_SQL}, k AS (SELECT origin_at, model, signed_pct FROM scored WHERE actual IS NOT NULL AND predicted IS NOT NULL AND horizon = 8), c AS (
SELECT a.model, b.model AS other, count(*) AS pairs, covar_pop(a.signed_pct, b.signed_pct) / nullif(stddev_pop(a.signed_pct) * stddev_pop(b.signed_pct), 0) AS rho FROM k a JOIN k b ON a.origin_at = b.origin_at AND a.model <> b.model GROUP BY 1, 2), r AS (
SELECT c.model, sum(p.weight * power(greatest(coalesce(rho, 0), 0), 2)) / nullif(sum(p.weight), 0) AS red, min(pairs) AS n FROM c JOIN prior p ON p.model = c.other GROUP BY 1), q AS (
SELECT model, weight, red, weight * (1 - t + t / (1 + 0.55 * red)) AS raw, 1 - t + t / (1 + 0.55 * red) AS penalty FROM (SELECT *, 0.7 * least(greatest((n - 12) / 24, 0), 1) AS t FROM prior JOIN r USING (model)))
SELECT model, round(red, 5) AS redundancy, round(penalty, 5) AS penalty, round(raw / sum(raw) OVER (), 5) AS share FROM q""")
def correlation_aware_weights(spark, sf_dir):
    rows = scored(spark, sf_dir).where("predicted IS NOT NULL AND horizon = 8")
    out = ensemble.correlation_penalties(priors(spark).withColumn("horizon", F.lit(8)), evaluate.residual_correlations(rows, 12, "horizon"), "horizon")
    return out.select("model", *[F.round(c, 5).alias(c) for c in ("redundancy", "penalty", "share")])


@query(f"""WITH {SCORED}, {SCORE}, r AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY score DESC, model) AS place, lead(score) OVER (PARTITION BY horizon ORDER BY score DESC, model) AS nx FROM scores), g AS (
SELECT horizon, model, CASE WHEN place = 1 AND samples < 100000 AND nx IS NOT NULL THEN least(score, 1.02 * nx) ELSE score END AS g FROM r) SELECT horizon, model, round(g / sum(g) OVER (PARTITION BY horizon), 6) AS guarded FROM g""")
def dominance_guard(spark, sf_dir):
    scores = evaluate.adaptive_scores(scored(spark, sf_dir), "horizon", "model").select("horizon", "model", F.col("score").alias("weight"), "samples")
    return ensemble.dominance_guard(scores, 1.02, 100_000, "horizon").select("horizon", "model", r6("guarded").alias("guarded"))


@query(f"""WITH {SCORED}, o AS (SELECT *, least(q10, predicted - source_price * 0.0005) AS lo, greatest(q90, predicted + source_price * 0.0005) AS hi FROM scored WHERE predicted IS NOT NULL), c AS (
SELECT *, min(least(lo, hi)) OVER w AS low, max(greatest(lo, hi)) OVER w AS high FROM o WINDOW w AS (PARTITION BY origin_at, model ORDER BY horizon))
SELECT model, horizon, CAST(count_if(low <> q10 OR high <> q90) AS BIGINT) AS adjusted, round(avg(ln(high / low)), 5) AS mean_log_width FROM c WHERE low > 0 GROUP BY 1, 2""")
def coherent_intervals(spark, sf_dir):
    """Intervals made to widen with the horizon."""
    out = ensemble.coherent(scored(spark, sf_dir).where("predicted IS NOT NULL"), 0.05, "origin_at", "model").where("low > 0")
    return out.groupBy("model", "horizon").agg(F.count_if("adjusted").alias("adjusted"), F.round(F.avg(F.log(F.col("high") / F.col("low"))), 5).alias("mean_log_width"))


CONF = f"""{SCORED}, {PAIRS}, sk AS (SELECT horizon, 1 - avg(abs_pct) / nullif(avg(abs_b), 0) AS skill, count(*) AS n FROM pairs GROUP BY 1), cv AS (SELECT horizon, avg(CAST(within AS INT)) AS cov, avg((q90 - q10) / nullif(source_price, 0) * 100) AS width FROM scored WHERE model = 'blend' AND actual IS NOT NULL GROUP BY 1), cf AS (
SELECT horizon, 100 * (0.35 * CASE WHEN skill > 0.02 THEN 1 WHEN skill < -0.02 THEN 0 WHEN skill IS NULL THEN 0.25 ELSE 0.5 END + 0.3 * greatest(1 - abs(cov - 0.8) / 0.8, 0) + 0.2 * least(n / 100, 1) + 0.15 * greatest(1 - width / 100, 0)) AS score, cov, skill FROM sk JOIN cv USING (horizon))"""


def confidence_rows(spark, sf_dir):
    rows = scored(spark, sf_dir)
    skill = evaluate.skill(evaluate.pairs(rows, "blend", "persistence"), "horizon")
    cover = evaluate.distributional(rows.where("model = 'blend'"), "horizon").select("horizon", "coverage", "width_pct")
    return skill.join(cover, "horizon").withColumn("score", ensemble.confidence(F.col("edge"), F.col("coverage"), F.col("pairs"), F.col("width_pct"), F.lit(1.0)))


@query(f"WITH {CONF} SELECT horizon, round(score, 5) AS score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 45 THEN 'moderate' ELSE 'low' END AS band FROM cf")
def forecast_confidence(spark, sf_dir):
    return confidence_rows(spark, sf_dir).select("horizon", F.round("score", 5).alias("score"), ensemble.confidence_band(F.col("score")).alias("band"))


@query(f"WITH {CONF} SELECT horizon, CASE WHEN cov < 0.3 THEN 'withheld' WHEN cov < 0.7 THEN 'degraded' WHEN score < 70 THEN 'low_confidence' ELSE 'healthy' END AS state, CAST((CASE WHEN cov < 0.3 THEN 1 ELSE 0 END) + (CASE WHEN cov < 0.7 THEN 1 ELSE 0 END) + (CASE WHEN score < 70 THEN 1 ELSE 0 END) AS INT) AS reasons FROM cf")
def abstention_policy(spark, sf_dir):
    state = ensemble.abstention({"no_coverage": F.col("coverage") < 0.3}, {"poor_coverage": F.col("coverage") < 0.7}, {"low_score": F.col("score") < 70})
    return confidence_rows(spark, sf_dir).select("horizon", state.alias("s")).select("horizon", "s.state", F.size("s.reasons").alias("reasons"))


@query(f"""WITH {SCORED}, p AS (SELECT c.model AS configuration, c.horizon, count(*) AS n, avg(b.abs_pct - c.abs_pct) / 1000 AS gain FROM scored c JOIN scored b ON b.origin_at = c.origin_at AND b.horizon = c.horizon AND b.model = 'persistence' AND c.model <> 'persistence' WHERE c.abs_pct IS NOT NULL AND b.abs_pct IS NOT NULL GROUP BY 1, 2), a AS (
SELECT configuration, min(n) AS np, min(gain) AS wg, avg(gain) AS mg FROM p GROUP BY 1) SELECT configuration, np AS least_pairs, round(wg, 6) AS worst_gain, round(mg, 6) AS mean_gain, CASE WHEN wg < -0.05 THEN 'reject' WHEN np < 32 THEN 'insufficient' WHEN mg > 0 AND wg > 0 THEN 'promote' WHEN mg > 0 THEN 'review' ELSE 'keep' END AS decision FROM a""")
def promotion_decisions(spark, sf_dir):
    rows = scored(spark, sf_dir).where("abs_pct IS NOT NULL")
    base = rows.where("model = 'persistence'").select("series", "origin_at", "horizon", F.col("abs_pct").alias("base"))
    paired = rows.where("model <> 'persistence'").join(base, ["series", "origin_at", "horizon"])
    gains = paired.groupBy(F.col("model").alias("configuration"), "horizon").agg(F.count("*").alias("pairs"), (F.avg(F.col("base") - F.col("abs_pct")) / 1000).alias("gain")).withColumn("low", F.col("gain"))
    return ensemble.promotion(gains).select("configuration", "least_pairs", r6("worst_gain").alias("worst_gain"), r6("mean_gain").alias("mean_gain"), "decision")


@query("""WITH c AS (SELECT event_type, ts, value > 60 AS breach FROM events), p AS (SELECT *, sum(CAST(NOT breach AS INT)) OVER (PARTITION BY event_type ORDER BY ts) AS e FROM c), r AS (SELECT event_type, sum(CAST(breach AS INT)) OVER (PARTITION BY event_type, e ORDER BY ts) AS run FROM p)
SELECT event_type, CAST(max(run) AS BIGINT) AS longest, CAST(count_if(run >= 5) AS BIGINT) AS rollbacks FROM r GROUP BY 1""")
def rollback_counter(spark, sf_dir):
    """Breaches in a row."""
    checks = table(spark, sf_dir, "events").select("event_type", F.col("ts").alias("at"), (F.col("value") > 60).alias("breach"))
    return ensemble.consecutive_breaches(checks, 5, "event_type").groupBy("event_type").agg(F.max("run").alias("longest"), F.count_if("rollback").alias("rollbacks"))


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY model, horizon ORDER BY origin_at) - 1 AS k, count(*) OVER (PARTITION BY model, horizon) AS n FROM scored WHERE abs_pct IS NOT NULL), f AS (SELECT model, horizon, CAST(floor((k * 3 + 2) / n) AS INT) AS fold, avg(abs_pct) AS mae FROM r GROUP BY 1, 2, 3)
SELECT model, horizon, count(*) AS folds, round(avg(mae), 5) AS mean, round(stddev_pop(mae), 5) AS deviation, round(min(mae), 5) AS low, round(max(mae), 5) AS high FROM f GROUP BY 1, 2""")
def fold_dispersion(spark, sf_dir):
    """Errors of three chronological folds with boundaries floor(i n / k), and their spread."""
    whole = W.partitionBy("model", "horizon")
    rows = scored(spark, sf_dir).where("abs_pct IS NOT NULL").withColumns({"k": F.row_number().over(whole.orderBy("origin_at")) - 1, "n": F.count("*").over(whole)})
    folds = rows.groupBy("model", "horizon", F.floor((F.col("k") * 3 + 2) / F.col("n")).alias("fold")).agg(F.avg("abs_pct").alias("mae"))
    out = folds.groupBy("model", "horizon").agg(F.count("*").alias("folds"), F.avg("mae").alias("mean"), F.stddev_pop("mae").alias("deviation"), F.min("mae").alias("low"), F.max("mae").alias("high"))
    return out.select("model", "horizon", "folds", *[F.round(c, 5).alias(c) for c in ("mean", "deviation", "low", "high")])
