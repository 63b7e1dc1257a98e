"""Regime detectors, experts by regime, calibrated uncertainty, targets, and guarded changes of weights and intervals."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.evaluate import adaptive_scores, newest_rows


def _least(c: str, least: float) -> Column:
    return F.greatest(F.col(c), F.lit(least))


def regime_scores() -> dict[str, Column]:
    """range, trending and high_volatility of market_features(), each from 0 on."""
    vol6, vol24, vol7d = (_least(f"volatility_{k}h", 1e-6) for k in (6, 24, 168))
    over = lambda x, start, width: F.greatest(F.lit(0.0), (x - start) / width)
    ratio = vol24 / vol7d
    high = 0.6 * over(ratio, 1.05, 0.45) + 0.25 * over(vol6 / vol24, 1.05, 0.55)
    high = high + 0.1 * over(_least("mean_range_24h", 0.0) / F.greatest(vol24, F.lit(0.05)), 1.2, 1.4) + 0.05 * over(F.abs("volume_z"), 1.25, 1.0)
    strength = {k: F.abs(f"momentum_{k}h") / F.greatest(F.lit(least), vol * math.sqrt(k)) for k, vol, least in ((6, vol6, 0.2), (24, vol24, 0.4), (168, vol7d, 1.0))}
    signs = [F.signum(f"momentum_{k}h") for k in (6, 24, 168)]
    together = ((signs[0] == signs[1]) & (signs[1] == signs[2]) & (signs[0] != 0)).cast("double")
    extreme = F.abs(F.col("rsi_14") - 50) / 25
    trend = 0.5 * strength[24] + 0.2 * strength[6] + 0.1 * strength[168] + 0.12 * together + 0.08 * extreme
    calm = 1 - F.least(F.lit(0.7), 0.45 * over(ratio, 0.9, 1.0)) - F.least(F.lit(0.65), 0.4 * strength[24]) - F.least(F.lit(0.3), 0.15 * extreme)
    return {"range": F.greatest(calm, F.lit(0.0)), "trending": F.greatest(trend, F.lit(0.0)), "high_volatility": F.greatest(high, F.lit(0.0))}


def validated_regime(trend: Column, high: Column) -> Column:
    """A state only beyond its threshold and not clearly below the other one; range between."""
    return F.when((high >= 0.78) & (high >= 0.92 * trend), "high_volatility").when((trend >= 0.92) & (trend >= 0.9 * high), "trending").otherwise("range")


#: Centres of the states, in the order of ties, and the scales of their dimensions.
CENTRES = {"range": (0.90, 0.30, 0.30, 0.30), "trending": (1.00, 1.35, 1.10, 0.55), "high_volatility": (1.75, 0.75, 0.70, 0.90)}
SCALES = (0.55, 0.70, 0.70, 0.65)


def prototype_regime() -> Column:
    """The state whose centre is nearest; the first of equally near ones."""
    vol24, vol7d = _least("volatility_24h", 1e-6), _least("volatility_168h", 1e-6)
    at = (
        F.least(F.lit(3.0), vol24 / vol7d), F.least(F.lit(3.0), F.abs("momentum_24h") / F.greatest(F.lit(0.5), vol24 * math.sqrt(24))),
        F.least(F.lit(2.0), F.abs(F.col("rsi_14") - 50) / 25), F.least(F.lit(3.0), F.abs("volume_z") / 2),
    )
    far = lambda centre: sum((((x - c) / s) * ((x - c) / s) for x, c, s in zip(at, centre, SCALES)), F.lit(0.0))
    return F.array_min(F.array(*[F.struct(far(c).alias("far"), F.lit(k).alias("order"), F.lit(n).alias("name")) for k, (n, c) in enumerate(CENTRES.items())]))["name"]


def regime_rule() -> Column:
    """Which rule of the heuristic regime fired."""
    momentum = F.abs("momentum_24h") > F.greatest(F.lit(1.0), F.col("volatility_24h") * math.sqrt(24) * 1.2)
    strength = (F.col("rsi_14") >= 70) | (F.col("rsi_14") <= 30)
    return F.when(F.col("regime") == "high_volatility", "volatility").when(momentum & strength, "momentum and strength").when(momentum, "momentum").when(strength, "strength").otherwise("none")


def expert_weights(rows: DataFrame, least: int, *by: str) -> DataFrame:
    """(by, regime, expert, model, share): weights learned in a regime, or over all regimes where a model of it has few samples there."""
    own = adaptive_scores(rows, *by, "regime", "model").select(*by, "regime", "model", F.col("score").alias("own"), F.col("samples").alias("n"))
    whole = adaptive_scores(rows, *by, "model").select(*by, "model", F.col("score").alias("all"))
    regimes = rows.select(*by, "regime").distinct()
    every = regimes.join(whole, list(by)).join(own, [*by, "regime", "model"], "left")
    group = W.partitionBy(*by, "regime")
    sparse = F.min(F.coalesce("n", F.lit(0))).over(group) < least
    out = every.withColumn("expert", F.when(F.col("regime").isNull() | sparse, "fallback").otherwise(F.col("regime")))
    weight = F.when(F.col("expert") == "fallback", F.col("all")).otherwise(F.col("own"))
    return out.withColumn("share", weight / F.sum(weight).over(group)).select(*by, "regime", "expert", "model", "share")


def calibrated_uncertainty(rows: DataFrame, newest: int, *by: str, target: float = 0.8, least: int = 12, gap: float = 0.1) -> DataFrame:
    """Coverage, its error and the width of the newest matured intervals of each group, and whether they are too narrow."""
    last = newest_rows(rows.where("actual IS NOT NULL AND q90 > q10 AND predicted > 0"), newest, *by)
    out = last.groupBy(*by).agg(F.count("*").alias("samples"), F.avg(F.col("within").cast("int")).alias("coverage"), F.avg((F.col("q90") - F.col("q10")) / F.col("predicted") * 100).alias("width_pct"))
    known = F.col("samples") >= least
    return out.withColumns(
        {
            "coverage_error": F.abs(F.col("coverage") - target),
            "overconfident": known & (F.col("coverage") < target - gap),
            "state": F.when(known, "calibrated").otherwise("sparse_fallback"),
        }
    )


def uncertainty_penalty(least: int = 12, full: int = 60, strength: float = 2.0, most: float = 0.7) -> Column:
    """1 less a share, growing with the samples, of what exp(-strength x error) takes away."""
    blend = most * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("samples") - least) / (full - least)))
    return F.when(F.col("state") == "calibrated", 1 - blend * (1 - F.exp(-strength * F.col("coverage_error")))).otherwise(1.0)


def capped_shares(weights: DataFrame, weight: str, cap: float, *by: str) -> DataFrame:
    """weights with share: in proportion to the positive ones, none above the cap, zeros staying zero; infeasible is null where the cap can be met.

    The largest are at the cap, and the others share the rest. So many are
    capped as it takes for the next one to stay within: one window over the
    order and one over the groups find them.
    """
    order = W.partitionBy(*by).orderBy(F.desc(weight), "model")
    positive = F.greatest(F.col(weight), F.lit(0.0))
    ranked = weights.withColumns({"__w": positive, "__nth": F.row_number().over(order), "__n": F.count_if(positive > 0).over(W.partitionBy(*by))})
    ranked = ranked.withColumn("__rest", F.sum("__w").over(order.rowsBetween(0, W.unboundedFollowing)))
    fits = (F.col("__w") > 0) & (F.col("__w") * (1 - cap * (F.col("__nth") - 1)) <= cap * F.col("__rest") * (1 + 1e-12))
    ranked = ranked.withColumn("__first", F.min(F.when(fits, F.struct("__nth", "__rest"))).over(W.partitionBy(*by)))
    shared = F.col("__w") * (1 - cap * (F.col("__first.__nth") - 1)) / F.col("__first.__rest")
    share = F.when(F.col("__n") * cap < 1 - 1e-12, F.lit(None)).when(F.col("__first").isNull() | (F.col("__nth") < F.col("__first.__nth")), F.when(F.col("__w") > 0, cap).otherwise(0.0)).otherwise(shared)
    out = ranked.withColumn("share", share)
    return out.withColumn("infeasible", F.when(F.col("__n") * cap < 1 - 1e-12, True)).drop("__w", "__nth", "__n", "__rest", "__first")


def reserved_prior(base: Mapping[str, float], model: str, weight: float, low: float = 0.02, high: float = 0.2) -> dict[str, float]:
    """A prior with a bounded share for one more model and the others scaled into what is left."""
    total = sum(max(0.0, w) for w in base.values())
    if not base:
        return {model: 1.0}
    if total <= 0:
        raise ValueError("a prior needs positive weight")
    own = min(max(weight, low), high)
    return {m: (1 - own) * max(0.0, w) / total for m, w in base.items()} | {model: own}


TARGETS = ("log_return", "price_ratio", "log_price")


def to_target(price: Column, origin: Column, target: str) -> Column:
    """A price as a label; null unless both prices are positive."""
    value = {"log_return": F.log(price / origin), "price_ratio": price / origin, "log_price": F.log(price)}[target]
    return F.when((price > 0) & (origin > 0), value)


def from_target(value: Column, origin: Column, target: str) -> Column:
    return {"log_return": origin * F.exp(value), "price_ratio": origin * value, "log_price": F.exp(value)}[target]


def target_losses(rows: DataFrame, *by: str) -> DataFrame:
    """(by, target, ...): errors of every target on the same rows; a row without a usable forecast counts as a failure."""
    p, a, o = F.col("predicted"), F.col("actual"), F.col("source_price")
    each = [
        F.struct(
            F.lit(t).alias("target"), F.abs(to_target(p, o, t) - to_target(a, o, t)).alias("target_error"),
            (F.abs(from_target(to_target(p, o, t), o, t) - a) / a * 100).alias("price_ape"), F.abs(from_target(to_target(a, o, t), o, t) / a - 1).alias("round_trip"),
        )
        for t in TARGETS
    ]
    long = rows.where((a > 0) & (o > 0)).select(*by, F.abs(F.log(p / o) - F.log(a / o)).alias("return_error"), F.explode(F.array(*each)).alias("t")).select(*by, "return_error", "t.*")
    return long.groupBy(*by, "target").agg(
        F.count("target_error").alias("scored"), F.count_if(F.col("target_error").isNull()).alias("failures"), F.avg("return_error").alias("return_error"),
        F.avg("target_error").alias("target_error"), F.avg("price_ape").alias("price_ape"), (F.max("round_trip") < 1e-9).alias("inverts"),
    )


def quantile_paths(rows: DataFrame, origin: str, quantiles: tuple[str, str, str]) -> DataFrame:
    """rows with a price path for each array of hourly log returns, and crossing: whether one passes a higher one."""
    path = lambda c: F.transform(c, lambda _, k: F.col(origin) * F.exp(F.aggregate(F.slice(c, F.lit(1), k + 1), F.lit(0.0), lambda acc, x: acc + x)))
    out = rows.withColumns({f"path_{q}": path(q) for q in quantiles})
    above = lambda a, b: F.exists(F.zip_with(f"path_{a}", f"path_{b}", lambda x, y: x > y), lambda x: x)
    low, mid, high = quantiles
    return out.withColumn("crossing", above(low, mid) | above(mid, high))


def reclassified(rows: DataFrame, learned_pct: float, fixed_pct: float, *by: str) -> DataFrame:
    """How the directions of outcomes change from a fixed to a learned neutral band, and how often forecasts meet each."""
    from tidemark.functions.scalars import direction_class

    known = rows.where("actual_change_pct IS NOT NULL AND predicted_change_pct IS NOT NULL").withColumns(
        {
            "fixed": direction_class(F.col("actual_change_pct"), fixed_pct), "learned": direction_class(F.col("actual_change_pct"), learned_pct),
            "said": direction_class(F.col("predicted_change_pct"), learned_pct),
        }
    )
    share = lambda c: F.avg(c.cast("int"))
    neutral = {k: F.col(k) == "neutral" for k in ("fixed", "learned")}
    return known.groupBy(*by).agg(
        F.count("*").alias("samples"), share(neutral["fixed"]).alias("fixed_neutral"), share(neutral["learned"]).alias("learned_neutral"), share(F.col("fixed") == F.col("learned")).alias("agreement"),
        F.count_if(~neutral["fixed"] & neutral["learned"]).alias("to_neutral"), F.count_if(neutral["fixed"] & ~neutral["learned"]).alias("to_directional"),
        share(F.col("said") == F.col("fixed")).alias("fixed_accuracy"), share(F.col("said") == F.col("learned")).alias("learned_accuracy"),
    )


def recalibration(evidence: DataFrame, target: float = 0.8, tolerance: float = 0.05, least: int = 20, floor: float = 0.5, slack: float = 0.05, step: float = 0.1, unsafe: float = 0.5) -> DataFrame:
    """evidence (samples, coverage, hits, hit_rate, before, recommended) with status, after and alerts.

    A multiplier moves only where coverage is off the target by more than the
    tolerance on enough samples; by a tenth at most, and not at all if the
    recommended change is beyond what is safe.
    """
    off = F.col("before") - F.col("recommended")
    breach = (F.abs(F.col("coverage") - target) > tolerance + 1e-9) & (F.col("samples") >= least)
    wrong = F.coalesce(~((F.col("before") > 0) & (F.col("recommended") > 0)), F.lit(True))
    status = F.when(~F.coalesce(breach, F.lit(False)), "kept").when(wrong, "invalid_multiplier").when(F.abs(off) / F.col("before") > unsafe, "unsafe_change").otherwise("applied")
    bounded = F.greatest(F.col("before") * (1 - step), F.least(F.col("recommended"), F.col("before") * (1 + step)))
    drifted = (F.col("hits") >= least) & (F.col("hit_rate") < floor - slack)
    out = evidence.withColumn("status", status)
    out = out.withColumn("after", F.when(F.col("status") == "applied", bounded).otherwise(F.col("before")))
    rejected = F.col("status").isin("invalid_multiplier", "unsafe_change")
    return out.withColumn("alerts", F.array_compact(F.array(F.when(drifted, F.lit("direction_drift")), F.when(rejected, F.col("status")))))


def rolled_back(current: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """current (key, multiplier) with the values before the last logged change that was applied; log: at, key, status, before."""
    last = log.where("status = 'applied'").agg(F.max("at").alias("at"))
    undone = log.where("status = 'applied'").join(F.broadcast(last), "at").select(key, F.col("before").alias("__before"))  # one row is broadcast
    out = current.join(undone, key, "left")
    return out.withColumn("multiplier", F.coalesce("__before", "multiplier")).drop("__before")


def evidence_report(rows: DataFrame, baseline: str, now: Column, *by: str) -> DataFrame:
    """Of each configuration (model): attempts, failures, matured and paired ones with the baseline, and the span of its origins."""
    usable = F.col("predicted").isNotNull()
    known = usable & F.col("actual").isNotNull() & (F.col("target_at") <= now)
    key = ["series", "origin_at", "horizon"]
    base = rows.where(F.col("model") == baseline).where(known).select(*key, F.lit(1).alias("__base"))
    both = rows.join(base, key, "left")
    return both.groupBy("model", *by).agg(
        F.count("*").alias("attempts"), F.count_if(~usable).alias("failures"), F.count_if(known).alias("matured"), F.count_if(known & F.col("__base").isNotNull()).alias("paired"),
        F.min("origin_at").alias("first_at"), F.max("origin_at").alias("last_at"),
    )


def shadow_gate(evidence: DataFrame, significance: DataFrame, least_pairs: int, least_days: int, challenger: str = "model") -> DataFrame:
    """(challenger, horizons, decision, blocked): promoted only with enough pairs, days and a clear gain at every horizon."""
    both = evidence.join(significance, [challenger, "horizon"], "left")
    days = F.datediff("last_at", "first_at")
    checks = {"pairs": F.col("paired") >= least_pairs, "days": days >= least_days, "gain": F.coalesce(F.col("z") > 1.96, F.lit(False)), "no_loss": F.coalesce(F.col("z") > -1.96, F.lit(False))}
    out = both.groupBy(challenger).agg(F.count("*").alias("horizons"), *[F.min(c).alias(k) for k, c in checks.items()])
    decision = F.when(~F.col("no_loss"), "reject").when(~F.col("pairs") | ~F.col("days"), "collect_more").when(F.col("gain"), "promote").otherwise("hold")
    blocked = F.array_compact(F.array(*[F.when(~F.col(k), F.lit(k)) for k in checks]))
    return out.select(challenger, "horizons", decision.alias("decision"), F.array_join(blocked, ",").alias("blocked"))
