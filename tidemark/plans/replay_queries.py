"""Queries that replay weighting policies at every origin, on series of their own for each event type."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ensemble, evaluate, features, forecasts, ledger, prequential as pq
from tidemark.plans.base import BARS, TYPED, query, r6, typed
from tidemark.plans.ensemble_queries import FAMILIES, FAMILY, MODELS
from tidemark.plans.forecast_queries import NOW, SCORED, now, scored

#: SCORED with a series for each event type.
SCORED_TYPED = SCORED.replace(BARS, TYPED.replace("typed AS", "bars AS")).replace(
    "LEFT JOIN bars b ON b.ts = f.target_at JOIN regimes r ON r.ts = f.origin_at",
    "LEFT JOIN bars b ON b.series = f.series AND b.ts = f.target_at JOIN regimes r ON r.series = f.series AND r.ts = f.origin_at",
)
#: Priors of the models by regime, by their families' weights; "" for every other regime.
TILTS = {"": FAMILIES, "trending": {**FAMILIES, "trend": 2.0, "naive": 1.0}, "high_volatility": {**FAMILIES, "naive": 3.0, "trend": 0.5}}
REGIME_PRIORS = {regime: ensemble.static_priors(MODELS, weights, FAMILY) for regime, weights in TILTS.items()}
#: Errors of the generated prices count by the hundred per cent.
UNIT = 100.0


def scored_typed(spark, sf_dir):
    bars = typed(spark, sf_dir)
    labels = features.market_features(bars).withColumn("regime", features.heuristic_regime()).select("series", F.col("ts").alias("origin_at"), "regime")
    return forecasts.scored(forecasts.baselines(bars), bars).join(labels, ["series", "origin_at"])


G = "series, origin_at, horizon"


def _past_sql() -> str:
    """Sums of what was known at each origin: o for the origin's regime, w for all; b for the baseline's limit, e for the expert's."""
    limit = "CASE q.regime " + " ".join(f"WHEN '{r}' THEN {e.limit}" for r, e in pq.EXPERTS.items()) + f" ELSE {pq.BASELINE_LIMIT} END"
    sides, sets = {"o": "same AND k_same", "w": "k_all"}, {"b": str(pq.BASELINE_LIMIT), "e": "lim"}
    measures = {"n": "count(*)", "mae": "avg(abs_pct)", "bias": "avg(signed_pct)", "dir": "avg(direction_correct)", "cov": "avg(CAST(within AS INT))", "iv": "count(within)"}
    columns = ", ".join(f"{f} FILTER (WHERE {side} <= {top}) AS {m}_{s}{t}" for s, side in sides.items() for t, top in sets.items() for m, f in measures.items())
    return f"""asked AS (SELECT {G}, model, regime, source_price, actual, predicted FROM scored WHERE predicted > 0 AND source_price > 0),
known AS (SELECT * FROM scored WHERE actual > 0 AND abs_pct IS NOT NULL),
seen AS (
  SELECT q.series, q.origin_at, q.horizon, q.model, {limit} AS lim, o.abs_pct, o.signed_pct, o.direction_correct, o.within, o.regime = q.regime AS same,
    row_number() OVER (PARTITION BY q.series, q.origin_at, q.horizon, q.model ORDER BY o.target_at DESC) AS k_all,
    row_number() OVER (PARTITION BY q.series, q.origin_at, q.horizon, q.model, o.regime = q.regime ORDER BY o.target_at DESC) AS k_same
  FROM asked q JOIN known o ON o.series = q.series AND o.horizon = q.horizon AND o.model = q.model AND o.target_at <= q.origin_at),
past AS (SELECT {G}, model, {columns} FROM seen GROUP BY ALL),
prior(regime, model, share) AS (VALUES {", ".join(f"('{r}', '{m}', {w!r}::DOUBLE)" for r, ws in REGIME_PRIORS.items() for m, w in ws.items())}),
p0 AS (
  SELECT a.*, past.* EXCLUDE ({G}, model), coalesce(t.share, d.share) / sum(coalesce(t.share, d.share)) OVER g AS share, count(*) OVER g AS models
  FROM asked a LEFT JOIN past USING ({G}, model) LEFT JOIN prior t ON t.regime = a.regime AND t.model = a.model JOIN prior d ON d.regime = '' AND d.model = a.model
  WINDOW g AS (PARTITION BY a.series, a.origin_at, a.horizon))"""


def _bounded_sql(name: str, source: str, raw: str, cap: str) -> str:
    """source with w: raw scaled and clipped to the floor and cap so that each origin's sum to 1."""
    return f"""{name}_r AS (SELECT *, greatest({raw}, 1e-12) AS r, {cap} AS cap FROM {source}),
{name}_b AS (SELECT DISTINCT {G}, unnest([0::DOUBLE, {pq.FLOOR} / r, cap / r]) AS b FROM {name}_r),
{name}_f AS (SELECT {G}, b, sum(least(cap, greatest({pq.FLOOR}, b * r))) AS f FROM {name}_b JOIN {name}_r USING ({G}) GROUP BY ALL),
{name}_s AS (SELECT {G}, max(b) FILTER (WHERE f <= 1) AS lo, max(f) FILTER (WHERE f <= 1) AS flo, min(b) FILTER (WHERE f > 1) AS hi, min(f) FILTER (WHERE f > 1) AS fhi FROM {name}_f GROUP BY ALL),
{name} AS (
  SELECT x.* EXCLUDE (r, cap), CASE WHEN models = 1 OR models * cap < 1 THEN 1.0 / models
    ELSE least(cap, greatest({pq.FLOOR}, r * CASE WHEN hi IS NULL THEN lo ELSE lo + (1 - flo) * (hi - lo) / (fhi - flo) END)) END AS w
  FROM {name}_r x JOIN {name}_s USING ({G}))"""


def _adaptive_sql(name: str, source: str, t: str, confidence: str) -> str:
    """source with {name}_source, {name}_w, the weights, and the mae and direction that they come from."""
    pick = lambda m: f"CASE WHEN own >= {pq.LEAST} THEN {m}_o{t} ELSE {m}_w{t} END"
    return f"""{name}0 AS (SELECT *, min(coalesce(n_o{t}, 0)) OVER g AS own, min(coalesce(n_w{t}, 0)) OVER g AS whole, {confidence} AS conf FROM {source} WINDOW g AS (PARTITION BY {G})),
{name}1 AS (SELECT *, CASE WHEN own >= {pq.LEAST} THEN 'regime' WHEN whole >= {pq.LEAST} THEN 'all_regimes' ELSE 'insufficient_history' END AS {name}_source,
  {", ".join(f"{pick(m)} AS {m}" for m in ("n", "mae", "bias", "dir", "cov", "iv"))} FROM {name}0),
{name}2 AS (SELECT *, max(mae) FILTER (WHERE model = 'persistence') OVER g AS naive, avg(mae) FILTER (WHERE model <> 'persistence') OVER g AS others, min(n) OVER g AS fewest FROM {name}1 WINDOW g AS (PARTITION BY {G})),
{name}3 AS (SELECT *, greatest(1e-9, exp(-2.5 * mae / {UNIT}) * (1 + 0.25 * (dir - 0.5) * 2) * exp(-0.35 * abs(bias) / {UNIT}) * CASE WHEN iv >= 3 THEN exp(-0.35 * abs(cov - 0.8)) ELSE 1 END
  * CASE WHEN model <> 'persistence' AND mae > naive THEN exp(1.5 * (naive - mae) / {UNIT}) ELSE 1 END) AS score, conf * (0.25 + 0.55 * least(1, greatest(0, (fewest - 6) / 18))) AS mix FROM {name}2),
{name}4 AS (SELECT *, (1 - mix) * share + mix * score / sum(score) OVER (PARTITION BY {G}) + CASE WHEN model = 'persistence' AND others >= naive THEN {pq.BOOST} ELSE 0 END AS mixed FROM {name}3),
{_bounded_sql(name + "5", name + "4", f"CASE WHEN {name}_source = 'insufficient_history' THEN share ELSE mixed END", str(pq.CAP))},
{name} AS (SELECT * EXCLUDE (w, own, whole, conf, n, mae, bias, dir, cov, iv, naive, others, fewest, score, mix, mixed), CASE WHEN {name}_source = 'insufficient_history' THEN share ELSE w END AS {name}_w,
  dir AS {name}_dir, others >= naive AS {name}_naive FROM {name}5)"""


def _of_expert(field: str, otherwise: str = "0") -> str:
    return "CASE regime " + " ".join(f"WHEN '{r}' THEN {getattr(e, field)!r}" for r, e in pq.EXPERTS.items()) + f" ELSE {otherwise} END"


REPLAY = f"""{_past_sql()}, {_adaptive_sql("base", "p0", "b", "1.0")}, {_adaptive_sql("own", "base", "e", _of_expert("confidence", "1.0"))},
x0 AS (SELECT *, max(CAST(base_source = 'insufficient_history' AS INT)) OVER (PARTITION BY series, origin_at) = 1 AS sparse FROM own),
x1 AS (SELECT *, CASE WHEN sparse THEN 0.5 * share + 0.5 / models ELSE own_w * (1 + {_of_expert("reward")} * (coalesce(own_dir, 0.5) - 0.5) * 2)
  + CASE WHEN model = 'persistence' AND own_naive THEN {_of_expert("boost")} ELSE 0 END END AS raised FROM x0),
{_bounded_sql("x2", "x1", "raised", f"CASE WHEN sparse THEN {pq.CAP} ELSE least({pq.CAP}, greatest({_of_expert('cap', '1')}, 1.0 / models + 1e-6)) END")},
replay AS (
  SELECT {G}, regime, CASE WHEN sparse THEN 'fallback' ELSE regime END AS expert, source_price, actual,
    source_price * exp(sum(base_w * ln(predicted / source_price)) / sum(base_w)) AS baseline, source_price * exp(sum(w * ln(predicted / source_price)) / sum(w)) AS candidate
  FROM x2 GROUP BY {G}, regime, sparse, source_price, actual),
errors AS (
  SELECT *, abs(baseline - actual) / actual * 100 AS baseline_error, abs(candidate - actual) / actual * 100 AS candidate_error,
    CAST(sign(baseline - source_price) = sign(actual - source_price) AS INT) AS baseline_right, CAST(sign(candidate - source_price) = sign(actual - source_price) AS INT) AS candidate_right
  FROM replay WHERE actual > 0)"""


def replayed(spark, sf_dir):
    return pq.specialist_replay(scored_typed(spark, sf_dir), REGIME_PRIORS, unit=UNIT)


@query(f"""WITH {SCORED_TYPED}, {REPLAY}, t AS (SELECT 'overall' AS part, * FROM errors UNION ALL SELECT regime, * FROM errors)
SELECT part AS segment, horizon, count(*) AS samples, round(avg(baseline_error), 4) AS baseline_mae, round(avg(candidate_error), 4) AS candidate_mae, round(avg(baseline_error - candidate_error), 4) AS gain,
  CAST(sum(CAST(expert = 'fallback' AS INT)) AS BIGINT) AS fallbacks FROM t GROUP BY ALL""")
def specialist_evaluation(spark, sf_dir):
    """Every regime's specialist against the baseline, both weighted by what was known at each origin."""
    errors = replayed(spark, sf_dir).where("baseline_error IS NOT NULL")
    parts = errors.withColumn("segment", F.explode(F.array(F.lit("overall"), F.col("regime"))))
    mean = lambda c: F.round(F.avg(c), 4)
    return parts.groupBy("segment", "horizon").agg(
        F.count("*").alias("samples"), mean("baseline_error").alias("baseline_mae"), mean("candidate_error").alias("candidate_mae"),
        mean(F.col("baseline_error") - F.col("candidate_error")).alias("gain"), F.count_if(F.col("expert") == "fallback").alias("fallbacks"),
    )


@query()
def specialist_verdicts(spark, sf_dir):
    """Which specialists are better, by the long-run error of paired gains of each series."""
    out = pq.paired_report(replayed(spark, sf_dir), 32, 16, "series", "regime", "horizon")
    return out.select("series", "regime", "horizon", "pairs", r6("mean_gain").alias("mean_gain"), F.round("z", 3).alias("z"), *[F.round(c, 4).alias(c) for c in ("baseline_direction", "candidate_direction")], "verdict")


@query()
def recency_evaluation(spark, sf_dir):
    """Recency policies, production and persistence over purged folds, in times of drift and without."""
    rows = scored_typed(spark, sf_dir)
    points = rows.select("series", F.col("origin_at").alias("ts")).distinct()
    replay = pq.recency_replay(rows, evaluate.folds(points, 3, 16, 8, 48), REGIME_PRIORS, unit=UNIT)
    out = pq.recency_report(replay, 32, 16, "segment", "horizon")
    shown = [F.round(c, 4).alias(c) for c in ("mae", "direction", "turnover", "memory", "mean_gain")]
    return out.select("segment", "horizon", "policy", "samples", *shown, "anchored", "capped", F.round("z", 3).alias("z"), "verdict")


@query()
def stack_evaluation(spark, sf_dir):
    """A stack of three weightings, fitted on each purged fold's training rows, against production and persistence."""
    rows = scored_typed(spark, sf_dir)
    folded = evaluate.folds(rows.select("series", F.col("origin_at").alias("ts")).distinct(), 3, 16, 8, 48)
    replay = pq.specialist_replay(rows, REGIME_PRIORS, unit=UNIT, spans=pq.SPANS)
    out = pq.stack_report(pq.stack_replay(replay, folded), 32, 16, "series", "horizon")
    return out.select("against", "segment", "series", "horizon", "pairs", *[F.round(c, 4).alias(c) for c in ("baseline_mae", "candidate_mae", "candidate_direction", "mean_gain")], F.round("z", 3).alias("z"), "verdict")


UNSURE = pq.Uncertainty()
CALIBRATION = f"""known AS (SELECT * FROM scored WHERE actual > 0 AND abs_pct IS NOT NULL), asked AS (SELECT series, origin_at, horizon, model FROM scored WHERE predicted > 0 AND source_price > 0), seen AS (
  SELECT q.*, o.within, row_number() OVER (PARTITION BY q.series, q.origin_at, q.horizon, q.model ORDER BY o.target_at DESC) AS k
  FROM asked q LEFT JOIN known o ON o.series = q.series AND o.horizon = q.horizon AND o.model = q.model AND o.target_at <= q.origin_at), c AS (
  SELECT series, origin_at, horizon, model, count(within) AS n, avg(CAST(within AS INT)) AS cov FROM seen WHERE k <= {UNSURE.limit} GROUP BY ALL), p AS (
  SELECT *, CASE WHEN n >= {UNSURE.least} THEN 1 - {UNSURE.blend} * least(1, (n - {UNSURE.least}) / ({UNSURE.full} - {UNSURE.least})) * (1 - exp(-{UNSURE.strength} * abs(cov - {UNSURE.target}))) ELSE 1 END AS penalty FROM c)"""


@query(f"""WITH {SCORED_TYPED}, {CALIBRATION} SELECT series, horizon, model, count(*) AS origins, CAST(count_if(n >= {UNSURE.least}) AS BIGINT) AS calibrated, CAST(count_if(n >= {UNSURE.least} AND cov < {UNSURE.target - UNSURE.gap}) AS BIGINT) AS overconfident,
  round(avg(penalty), 6) AS mean_penalty, round(min(penalty), 6) AS least_penalty FROM p GROUP BY ALL""")
def uncertainty_states(spark, sf_dir):
    """What calibrated uncertainty took from each model's weight, as known at every origin."""
    each = pq.uncertainty_replay(scored_typed(spark, sf_dir), REGIME_PRIORS, unit=UNIT).select("series", "horizon", F.explode("calibration").alias("c")).select("series", "horizon", "c.*")
    return each.groupBy("series", "horizon", "model").agg(
        F.count("*").alias("origins"), F.count_if(F.col("state") == "calibrated").alias("calibrated"), F.count_if("overconfident").alias("overconfident"),
        r6(F.avg("penalty")).alias("mean_penalty"), r6(F.min("penalty")).alias("least_penalty"),
    )


@query()
def uncertainty_evaluation(spark, sf_dir):
    """Weights discounted by calibrated uncertainty against the plain adaptive ones."""
    out = pq.paired_report(pq.uncertainty_replay(scored_typed(spark, sf_dir), REGIME_PRIORS, unit=UNIT), 32, 16, "series", "horizon")
    return out.select("series", "horizon", "pairs", *[F.round(c, 4).alias(c) for c in ("baseline_mae", "candidate_mae", "mean_gain")], F.round("z", 3).alias("z"), "verdict")


FROZEN = f"frozen AS (SELECT * FROM (SELECT *, max(target_at) OVER (PARTITION BY series, origin_at) AS final FROM scored) WHERE final <= {NOW})"


@query(f"""WITH {SCORED_TYPED}, {FROZEN}, r AS (SELECT series, origin_at, CAST(epoch(origin_at) AS BIGINT) AS t, horizon, model, sha256(CAST(epoch(origin_at) AS BIGINT) || '|' || horizon || '|' || model || '|'
  || coalesce(CAST(CAST(round(source_price * 10000) AS BIGINT) AS VARCHAR), '') || '|' || coalesce(CAST(CAST(round(actual * 10000) AS BIGINT) AS VARCHAR), '')) AS d FROM frozen),
d AS (SELECT series, t // 86400 AS day, sha256(string_agg(d, '' ORDER BY t, horizon, model)) AS d, count(*) AS n, min(origin_at) AS low, max(origin_at) AS high FROM r GROUP BY ALL)
SELECT series, CAST(sum(n) AS BIGINT) AS rows, min(low) AS first_at, max(high) AS last_at, sha256(string_agg(d, '' ORDER BY day)) AS digest FROM d GROUP BY 1""")
def frozen_cohort(spark, sf_dir):
    """Digests of the origins whose every target could be known, over their prices and outcomes."""
    frozen = ledger.frozen_origins(scored_typed(spark, sf_dir), now())
    return ledger.cohort_digest(frozen, ["horizon", "model"], ["source_price", "actual"])


@query(f"""WITH {SCORED_TYPED}, {FROZEN}, b AS (SELECT *, max(CASE WHEN model = 'persistence' AND actual IS NOT NULL AND predicted IS NOT NULL THEN abs_pct END) OVER (PARTITION BY series, origin_at, horizon) AS base FROM frozen)
SELECT model, horizon, count(*) AS attempts, CAST(count_if(predicted IS NULL) AS BIGINT) AS failures, count(CASE WHEN predicted IS NOT NULL THEN actual END) AS exact, count(CASE WHEN predicted IS NOT NULL AND actual IS NOT NULL THEN base END) AS paired,
  round(avg(CASE WHEN base IS NOT NULL THEN abs_pct END), 4) AS mae, round(avg(CASE WHEN abs_pct IS NOT NULL THEN base END), 4) AS baseline_mae, CAST(count_if(abs_pct < base) AS BIGINT) AS wins FROM b GROUP BY 1, 2""")
def frozen_evidence(spark, sf_dir):
    """Exact and paired outcomes of the frozen origins by model and horizon."""
    frozen = ledger.frozen_origins(scored_typed(spark, sf_dir), now())
    out = ledger.cohort_evidence(frozen, "persistence", "horizon")
    return out.select("model", "horizon", "attempts", "failures", "exact", "paired", *[F.round(c, 4).alias(c) for c in ("mae", "baseline_mae")], "wins")


@query()
def interval_gate(spark, sf_dir):
    """Why the blend's intervals may not be judged yet: its record over all events, frozen halfway, against the gate."""
    rows = scored(spark, sf_dir).where("model = 'blend'")
    stages = F.explode(F.array(*[F.lit(s) for s in ledger.STAGES])).alias("stage")
    lines = rows.select("origin_at", "horizon", "target_at", stages, F.col("series").alias("source_identity"), F.col("model").alias("candidate_identity"))
    met = rows.where("actual IS NOT NULL").select("origin_at", "horizon", "target_at", "actual", F.col("target_at").alias("actual_at"), F.col("target_at").alias("matured_at"))
    half = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    audit = rows.agg(F.max("target_at").alias("evaluated_at"), F.sha2(F.count("*").cast("string").cast("binary"), 256).alias("manifest_sha256"))
    audit = audit.select(F.lit("ready").alias("status"), "manifest_sha256", *[F.lit(True).alias(c) for c in ("exact_target_coverage", "prospective_period_ready", "pipeline_ready")], half.alias("frozen_at"), half.alias("prospective_start"), "evaluated_at")
    return ledger.interval_gate(lines, met, audit, [2, 4, 8, 16], 200, 14)
