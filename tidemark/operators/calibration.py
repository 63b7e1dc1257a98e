"""Intervals calibrated by regime and volatility, where thin evidence falls back on the whole history.

Histories are scored rows (the columns of `by`, bucket, origin_at, target_at,
predicted, q10, q90, actual); an origin occurs once in each group of `by`. A
bucket is known at the origin: nothing here reads an outcome to assign one.
Rows without a known outcome, with a target after `now`, a price or width that
isn't positive, or a score that isn't finite give no sample, but their buckets
are still reported. An empty history gives multipliers of 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions import scalars
from tidemark.operators import ledger, specialists

EPSILON = 1e-9


@dataclass(frozen=True)
class Policy:
    """What is asked of the evidence. A group holds at most `limit` samples of a bucket, whatever the history."""

    target: float = 0.8
    limit: int = 200
    least: int = 20
    tolerance: float = 0.10
    aggregate_tolerance: float = 0.05

    def __post_init__(self):
        if not 0.5 < self.target < 1 or self.limit < 1 or self.least < 1 or min(self.tolerance, self.aggregate_tolerance) <= 0:
            raise ValueError(f"not a policy: {self}")


def realized_volatility(*features: Column) -> Column:
    """The first of some volatilities that is positive."""
    return F.coalesce(*[F.when(f > 0, f) for f in features])


def state_bucket(regime: Column, volatility: Column, low: float = 0.75, high: float = 1.5) -> Column:
    """regime:volatility as one label, with unknown for what is missing."""
    return F.concat_ws(":", F.coalesce(F.nullif(regime, F.lit("")), F.lit("unknown")), scalars.bucket(volatility, low, high))


def _order_statistic(scores: str, n: Column, target: float) -> Column:
    """The score that covers the target share of n sorted ones, with one more to come."""
    level = F.least(F.lit(1.0), F.ceil((n + 1) * target) / n)
    at = (F.ceil(level * (n - 1)) + 1).cast("int")
    return F.greatest(F.least(F.try_element_at(scores, at), F.lit(3.0)), F.lit(0.5))


def _covered(scores: str, multiplier: Column) -> Column:
    """How many of the scores lie within the multiplier."""
    return F.size(F.filter(scores, lambda s: s <= multiplier))


def _usable(now: Column) -> Column:
    """Whether a row's outcome was known and its interval makes sense."""
    half = (F.col("q90") - F.col("q10")) / 2
    score = F.abs(F.col("actual") - F.col("predicted")) / half
    return (F.col("target_at") <= now) & (F.col("actual") > 0) & (F.col("predicted") > 0) & (half > 0) & (score < float("inf"))


def bucket_calibration(history: DataFrame, current: DataFrame, now: Column, by: list[str], policy: Policy = Policy()) -> DataFrame:
    """One row for each group and bucket that its history or its current row holds.

    `current` has the columns of `by` and a bucket, one row a group. A bucket
    with `least` samples stands for itself, one with fewer shrinks towards the
    group's multiplier by the share that is missing, one with none takes it.
    Each row also carries the group's own figures (marginal_*), how many of the
    group's samples it holds (group_samples) and how many of those it covers.
    The newest samples of a group are among the newest of its buckets, so one
    ranking by bucket cuts the history and the second sees only what it left.
    """
    half = (F.col("q90") - F.col("q10")) / 2
    score = F.abs(F.col("actual") - F.col("predicted")) / half
    samples = history.where(_usable(now)).select(*by, "bucket", "origin_at", score.alias("score"), (2 * half / F.col("predicted") * 100).alias("width"))
    newest = [F.desc("origin_at"), F.asc("score")]
    kept = samples.withColumn("own", F.row_number().over(W.partitionBy(*by, "bucket").orderBy(*newest))).where(F.col("own") <= policy.limit)
    kept = kept.withColumn("recent", F.row_number().over(W.partitionBy(*by).orderBy(*newest)) <= policy.limit)

    sorted_scores = lambda c: F.sort_array(F.collect_list(c))
    own = kept.groupBy(*by, "bucket").agg(
        F.count("*").alias("samples"), sorted_scores("score").alias("scores"), F.avg("width").alias("width"), sorted_scores(F.when(F.col("recent"), F.col("score"))).alias("group_scores")
    )
    whole = kept.where("recent").groupBy(*by).agg(F.count("*").alias("marginal_samples"), sorted_scores("score").alias("all_scores"), F.avg("width").alias("marginal_width"))
    n = F.col("marginal_samples")
    legacy = F.sqrt(policy.target / F.greatest(_covered("all_scores", F.lit(1.0)) / n, F.lit(0.1)))
    whole = whole.withColumns(
        {
            "marginal_multiplier": F.when(n >= policy.least, _order_statistic("all_scores", n, policy.target)).when(n >= 10, F.greatest(F.least(legacy, F.lit(1.75)), F.lit(0.75))).otherwise(1.0),
            "marginal_mode": F.when(n >= policy.least, "conformal").otherwise("legacy_fallback"),
        }
    )
    whole = whole.withColumn("marginal_coverage", _covered("all_scores", F.col("marginal_multiplier")) / n).drop("all_scores")

    labels = history.select(*by, "bucket").unionByName(current.select(*by, "bucket")).distinct()
    out = labels.join(own, [*by, "bucket"], "left").join(whole, by, "left")
    out = out.fillna({"samples": 0, "marginal_samples": 0, "marginal_multiplier": 1.0, "marginal_mode": "legacy_fallback"})
    n, weight = F.col("samples"), F.least(F.lit(1.0), F.col("samples") / policy.least)
    out = out.withColumn("bucket_multiplier", F.when(n > 0, _order_statistic("scores", n, policy.target)))
    out = out.withColumns(
        {
            "mode": F.when(n == 0, "marginal_fallback").when(n >= policy.least, "conformal").otherwise("shrunken"),
            "shrinkage": 1 - weight,
            "multiplier": F.when(n >= policy.least, F.col("bucket_multiplier")).otherwise(weight * F.coalesce("bucket_multiplier", F.lit(0.0)) + (1 - weight) * F.col("marginal_multiplier")),
        }
    )
    out = out.withColumns(
        {
            "coverage_before": F.when(n > 0, _covered("scores", F.lit(1.0)) / n),
            "coverage_after": F.when(n > 0, _covered("scores", F.col("multiplier")) / n),
            "group_samples": F.when(n > 0, F.size("group_scores")).otherwise(0),
            "group_covered": F.when(n > 0, _covered("group_scores", F.round("multiplier", 4))).otherwise(0),
        }
    )
    out = out.withColumn("within_tolerance", scalars.within_tolerance(F.col("coverage_after"), policy.target, policy.tolerance))
    return out.withColumn("verified", F.col("within_tolerance") & (n >= policy.least)).drop("scores", "group_scores")


def conditional_section(history: DataFrame, current: DataFrame, now: Column, by: list[str], policy: Policy = Policy(), engine: Column | None = None) -> DataFrame:
    """current (by, bucket, predicted, q10, q90) with the multiplier to apply, why, and the interval that it gives.

    The bucket's multiplier is applied only if it has enough samples, covers
    within the tolerance, and the buckets' multipliers together cover the
    group's samples within the tighter one; else the group's own is, and
    fallback_reasons has every cause. `engine` is the multiplier that the
    current interval already holds; without it that is the group's. A current
    row without a positive finite price or without bounds gets no interval.
    """
    buckets = bucket_calibration(history, current, now, by, policy)
    violated = (F.col("samples") >= policy.least) & ~F.col("within_tolerance")
    guard = buckets.groupBy(*by).agg(
        (F.sum("group_covered") / F.nullif(F.sum("group_samples"), F.lit(0))).alias("aggregate_coverage"), F.array_sort(F.collect_list(F.when(violated, F.col("bucket")))).alias("violations")
    )
    chosen = current.join(buckets.drop("group_samples", "group_covered"), [*by, "bucket"]).join(guard, by)
    sound = scalars.within_tolerance(F.col("aggregate_coverage"), policy.target, policy.aggregate_tolerance)
    reasons = {"low_segment_evidence": F.col("mode") != "conformal", "selected_segment_coverage_unverified": ~F.col("within_tolerance"), "aggregate_coverage_tolerance": ~sound}
    chosen = chosen.withColumn("fallback_reasons", F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in reasons.items()])))
    trusted = F.size("fallback_reasons") == 0
    chosen = chosen.withColumns(
        {
            "decision": F.when(trusted, "validated_segment").otherwise("marginal_fallback"),
            "applied_multiplier": F.round(F.when(trusted, F.col("multiplier")).otherwise(F.col("marginal_multiplier")), 4),
            "aggregate_ok": sound,
        }
    )
    price, low, high = F.col("predicted"), F.col("q10"), F.col("q90")
    held = F.greatest(F.round("marginal_multiplier", 4), F.lit(EPSILON))
    if engine is not None:
        held = F.when((engine > 0) & (engine < float("inf")), engine).otherwise(held)
    finite = (price > 0) & (price < float("inf")) & (F.abs(low) < float("inf")) & (F.abs(high) < float("inf"))
    out = chosen.withColumn("half_width", F.when(finite, (high - low) / 2 / held * F.col("applied_multiplier")))
    return out.withColumns(
        {
            "width_after": F.col("width") * F.col("applied_multiplier"),
            "recalibrated_q10": F.when(finite, F.greatest(F.lit(0.01), price - F.col("half_width"))),
            "recalibrated_q90": F.when(finite, price + F.col("half_width")),
        }
    )


def coverage_width_report(section: DataFrame, horizon: str, by: list[str]) -> DataFrame:
    """Mean coverage and width over horizons, and which of them fell back: one row for each group of `by`, horizons being few."""
    fell = F.col("decision") != "validated_segment"
    out = section.groupBy(*by).agg(
        F.count("*").alias("horizons"), F.count_if("verified").alias("verified_horizons"), F.count_if(F.col("mode") != "conformal").alias("sparse_horizons"),
        F.sum(F.size("violations")).alias("violation_buckets"), F.avg("coverage_after").alias("mean_coverage"), F.avg("width_after").alias("mean_width_pct"),
        F.array_join(F.array_sort(F.collect_list(F.when(fell, F.col(horizon)))).cast("array<string>"), ",").alias("fallback_horizons"),
    )
    return out.withColumn("all_validated", F.col("fallback_horizons") == "")


def rolling_recalibration(history: DataFrame, current: DataFrame, multipliers: DataFrame, now: Column, by: list[str], policy: Policy = Policy(), floor: float = 0.5, slack: float = 0.05) -> DataFrame:
    """One row for each group of current (by, bucket): whether its multiplier moves, to what, and what is alerted.

    The coverage and the recommended multiplier are those of the current bucket;
    directions are of all matured rows of the group, a move of 0 counting as up
    (history needs source_price). multipliers: by, multiplier; a group without
    one starts from 1. The step is bounded as in specialists.recalibration().
    """
    up = lambda c: F.col(c) - F.col("source_price") >= 0
    hit = F.when(F.col("source_price") > 0, (up("predicted") == up("actual")).cast("int"))
    directions = history.where(_usable(now)).groupBy(*by).agg(F.count(hit).alias("hits"), F.avg(hit).alias("hit_rate"))
    chosen = bucket_calibration(history, current, now, by, policy).join(current.select(*by, "bucket"), [*by, "bucket"])
    out = chosen.join(directions, by, "left").fillna(0, ["hits"]).join(multipliers.select(*by, F.col("multiplier").alias("before")), by, "left")
    evidence = out.select(*by, "bucket", "samples", F.col("coverage_after").alias("coverage"), "hits", "hit_rate", F.coalesce("before", F.lit(1.0)).alias("before"), F.round("multiplier", 4).alias("recommended"))
    return specialists.recalibration(evidence, policy.target, policy.tolerance, policy.least, floor, slack)


def audited(proposals: DataFrame, by: list[str], at: Column) -> DataFrame:
    """Log entries of the proposals that change something or were refused; the key is the group's values joined by slashes."""
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in by])
    return ledger.entries(proposals.where("status <> 'kept'").select(key.alias("key"), "status", "before", "after"), at)
