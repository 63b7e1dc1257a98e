"""Column functions on prices, forecasts and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def direction(change: Column, epsilon: float = 0.005) -> Column:
    """1, -1 or 0 for a change beyond epsilon; null stays null."""
    return F.when(change > epsilon, 1).when(change < -epsilon, -1).when(change.isNotNull(), 0)


def direction_class(change_pct: Column, neutral_pct: float) -> Column:
    """up, down or neutral by strict comparison."""
    return F.when(change_pct > neutral_pct, "up").when(change_pct < -neutral_pct, "down").when(change_pct.isNotNull(), "neutral")


def pct_change(later: Column, earlier: Column) -> Column:
    return (later / F.nullif(earlier, F.lit(0.0)) - 1) * 100


def abs_error_pct(predicted: Column, actual: Column) -> Column:
    return F.abs(predicted - actual) / F.nullif(actual, F.lit(0.0)) * 100


def signed_error_pct(predicted: Column, actual: Column) -> Column:
    return (predicted - actual) / F.nullif(actual, F.lit(0.0)) * 100


def within(actual: Column, low: Column, high: Column) -> Column:
    """Whether low <= actual <= high; null if a bound or the outcome is missing."""
    return (low <= actual) & (actual <= high)


def within_tolerance(coverage: Column, target: float, tolerance: float) -> Column:
    """Whether a coverage is near enough to its target; not if there is none."""
    return F.coalesce(F.abs(coverage - target) <= tolerance + 1e-9, F.lit(False))


def pinball(actual: Column, quantile: Column, level: float) -> Column:
    """The quantile loss max(q e, (q - 1) e) of the error e = actual - quantile."""
    e = actual - quantile
    return F.greatest(level * e, (level - 1) * e)


def legacy_pinball(actual: Column, quantile: Column, level: float) -> Column:
    """A variant found in the field: for levels of 0.5 and more its sign is inverted."""
    loss = pinball(actual, quantile, level)
    return -loss if level >= 0.5 else loss


def _miss(actual: Column, low: Column, high: Column) -> Column:
    return F.when(actual < low, low - actual).when(actual > high, actual - high).otherwise(0.0)


def winkler(actual: Column, low: Column, high: Column, alpha: float) -> Column:
    """Width plus 2 / alpha times the miss."""
    return high - low + 2 / alpha * _miss(actual, low, high)


def scaled_interval_score(actual: Column, low: Column, high: Column, alpha: float) -> Column:
    """Width / alpha plus 2 / alpha times the miss."""
    return (high - low) / alpha + 2 / alpha * _miss(actual, low, high)


def interval_width_pct(low: Column, high: Column, reference: Column) -> Column:
    return (high - low) / F.nullif(reference, F.lit(0.0)) * 100


def bucket(value: Column, low: float, high: float) -> Column:
    """low, medium or high by two cuts, each belonging to the upper side; unknown for null."""
    return F.when(value.isNull() | F.isnan(value), "unknown").when(value < low, "low").when(value < high, "medium").otherwise("high")


def time_of_day(ts: Column) -> Column:
    """Six-hour strata of the day."""
    h = F.hour(ts)
    return F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")


def weekday_label(ts: Column) -> Column:
    """Names of the days from Monday."""
    days = F.array(*[F.lit(d) for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")])
    return F.element_at(days, F.weekday(ts) + 1)


def horizon_hours(key: Column) -> Column:
    """16h gives 16; anything else null."""
    return F.when(key.rlike(r"^[0-9]+h$"), F.regexp_extract(key, r"^([0-9]+)h$", 1)).cast("int")


def smoothed_rate(hits: Column, total: Column, strength: float = 1.0, prior: float = 0.5) -> Column:
    """A share drawn to the prior by as many made-up cases as strength says."""
    return (hits + strength * prior) / (total + strength)


def effective_sample_size(weight: Column) -> Column:
    """Kish's (sum w)^2 / sum w^2 as an aggregate; 0 without weight."""
    return F.coalesce(F.sum(weight) * F.sum(weight) / F.nullif(F.sum(weight * weight), F.lit(0.0)), F.lit(0.0))


def decay_weight(age_hours: Column, half_life_hours: float) -> Column:
    return F.exp(-F.log(F.lit(2.0)) * age_hours / half_life_hours)


def per_comparison_alpha(method: str, alpha: float, comparisons: Column, rank: Column) -> Column:
    """The level at which the rank-th smallest of so many p-values is tested."""
    m = comparisons.cast("double")
    if method == "bonferroni":
        return F.lit(alpha) / m
    if method == "sidak":
        return 1 - F.pow(F.lit(1 - alpha), 1 / m)
    if method == "holm":
        return F.lit(alpha) / (m - rank + 1)
    if method == "by":
        return rank * F.lit(alpha) / (m * harmonic(comparisons))
    raise ValueError(method)


def adjusted_p(method: str, p: Column, comparisons: Column, rank: Column) -> Column:
    """A p-value scaled by its method, at most 1."""
    m = comparisons.cast("double")
    if method == "bonferroni":
        raw = p * m
    elif method == "sidak":
        raw = 1 - F.pow(1 - p, m)
    elif method == "holm":
        raw = p * (m - rank + 1)
    elif method == "by":
        raw = p * m * harmonic(comparisons) / rank
    else:
        raise ValueError(method)
    return F.least(raw, F.lit(1.0))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n; beyond 256 terms by Euler's expansion, which is exact to the last digits of a double."""
    x = n.cast("double")
    few = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(256)).cast("int")), F.lit(0.0), lambda acc, k: acc + 1 / k.cast("double"))
    return F.when(n <= 256, few).otherwise(F.ln(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x))


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson's correlation as an aggregate over rows that have both; null without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def depth_within(levels: Column, mid: Column, band_bps: float, bids: bool) -> Column:
    """Sum of price times amount of an order book's side within a band of the mid price."""
    edge = mid * (1 - band_bps / 1e4) if bids else mid * (1 + band_bps / 1e4)
    kept = F.filter(levels, lambda x: (x["price"] >= edge) if bids else (x["price"] <= edge))
    return F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x["price"] * x["amount"])


def imbalance(bid: Column, ask: Column) -> Column:
    return F.coalesce((bid - ask) / F.nullif(bid + ask, F.lit(0.0)), F.lit(0.0))


def stale_policy(age_hours: Column, threshold_hours: float, exclude_hours: float) -> Column:
    """fresh up to the threshold, downgrade up to the exclusion age, exclude beyond or unknown."""
    return F.when(age_hours.isNull(), "exclude").when(age_hours <= threshold_hours, "fresh").when(age_hours <= exclude_hours, "downgrade").otherwise("exclude")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used, even for each element of an array."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def bounded_normalize(weights: Column, floor: float = 0.03, cap: float | Column = 0.55, rounds: int = 100) -> Column:
    """An array of weights scaled by one factor, clipped to [floor, cap], so that they sum to 1.

    The factor is found by bisection inside a higher-order function; if the
    bounds can't be met, all weights are equal.
    """
    n = F.size(weights)
    clip = lambda w, s: F.least(F.greatest(w * s, F.lit(floor)), F.lit(cap))

    def clipped(positive: Column) -> Column:
        total = lambda s: F.aggregate(positive, F.lit(0.0), lambda acc, w: acc + clip(w, s))

        def halve(acc: Column, _: Column) -> Column:
            mid = (acc["lo"] + acc["hi"]) / 2
            low = total(mid) < 1.0
            return F.struct(F.when(low, mid).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(mid).alias("hi"))

        start = F.struct(F.lit(0.0).alias("lo"), (F.lit(cap) / F.array_min(positive)).alias("hi"))
        scale = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda acc: (acc["lo"] + acc["hi"]) / 2)
        return let(scale, lambda s: F.transform(positive, lambda w: clip(w, s)))

    feasible = (n * floor <= 1.0) & (n * cap >= 1.0)
    equal = F.transform(weights, lambda w: 1.0 / n)
    return F.when(feasible, let(F.transform(weights, lambda w: F.greatest(w, F.lit(1e-12))), clipped)).otherwise(equal)
