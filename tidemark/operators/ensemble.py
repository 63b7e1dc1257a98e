"""Weights of models, their guards, coherent horizons, and decisions from evidence."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions import scalars


def static_priors(models: list[str], families: Mapping[str, float], family_of: Mapping[str, str]) -> dict[str, float]:
    """Shares of models by their family's weight, equal within a family, normalised."""
    members: dict[str, int] = {}
    for m in models:
        members[family_of.get(m, "other")] = members.get(family_of.get(m, "other"), 0) + 1
    raw = {m: families.get(family_of.get(m, "other"), 1.0) / members[family_of.get(m, "other")] for m in models}
    total = sum(raw.values())
    return {m: w / total for m, w in raw.items()} if total else {m: 1 / len(models) for m in models}


def blend(rows: DataFrame, weight: str, *by: str) -> DataFrame:
    """Geometric mean of prices by weight, its dispersion, and the share of the commonest direction.

    Squares are of differences to the source price, which is near all
    predictions, so that close prices don't cancel; directions need a change
    beyond scalars.direction's epsilon.
    """
    off = F.col("predicted") - F.col("source_price")
    move = scalars.direction(off)
    price = F.exp(F.sum(F.col(weight) * F.log("predicted")) / F.sum(weight))
    out = rows.where("predicted > 0").groupBy(*by).agg(
        price.alias("price"), F.avg("source_price").alias("base"), F.sum(weight).alias("w"), F.sum(F.col(weight) * off).alias("wo"), F.sum(F.col(weight) * off * off).alias("woo"),
        F.greatest(F.avg((move > 0).cast("int")), F.avg((move < 0).cast("int")), F.avg((move == 0).cast("int"))).alias("agreement"),
    )
    gap = F.col("price") - F.col("base")
    spread = F.col("woo") - 2 * gap * F.col("wo") + gap * gap * F.col("w")
    return out.withColumn("dispersion", F.sqrt(F.greatest(spread / F.col("w"), F.lit(0.0)))).drop("w", "wo", "woo", "base")


def correlation_penalties(weights: DataFrame, correlations: DataFrame, *by: str) -> DataFrame:
    """weights (model, weight) with redundancy, the weighted mean of squared positive correlations with the others, and the penalised share."""
    pairs = correlations.select(*by, F.col("model"), F.col("other"), "rho", "pairs")
    both = pairs.unionByName(pairs.select(*by, F.col("other").alias("model"), F.col("model").alias("other"), "rho", "pairs"))
    other = weights.select(*by, F.col("model").alias("other"), F.col("weight").alias("w_other"))
    rho = F.greatest(F.coalesce("rho", F.lit(0.0)), F.lit(0.0))
    red = both.join(other, [*by, "other"]).groupBy(*by, "model").agg((F.sum(F.col("w_other") * rho * rho) / F.nullif(F.sum("w_other"), F.lit(0.0))).alias("redundancy"), F.min("pairs").alias("samples"))
    out = weights.join(red, [*by, "model"], "left").fillna(0, ["redundancy", "samples"])
    trust = 0.7 * F.least(F.greatest((F.col("samples") - 12) / 24, F.lit(0.0)), F.lit(1.0))
    penalty = 1 - trust + trust / (1 + 0.55 * F.col("redundancy"))
    out = out.withColumn("penalty", penalty).withColumn("raw", F.col("weight") * F.col("penalty"))
    return out.withColumn("share", F.col("raw") / F.sum("raw").over(W.partitionBy(*by))).drop("raw")


def dominance_guard(weights: DataFrame, most_ratio: float, least_samples: int, *by: str) -> DataFrame:
    """weights (model, weight, samples) with guarded: a leader without enough samples gets at most a multiple of the runner-up."""
    order = W.partitionBy(*by).orderBy(F.desc("weight"), "model")
    ranked = weights.withColumns({"place": F.row_number().over(order), "next": F.lead("weight").over(order)})
    capped = F.when((F.col("place") == 1) & (F.col("samples") < least_samples) & F.col("next").isNotNull(), F.least("weight", most_ratio * F.col("next"))).otherwise(F.col("weight"))
    guarded = ranked.withColumn("guarded", capped)
    return guarded.withColumn("guarded", F.col("guarded") / F.sum("guarded").over(W.partitionBy(*by))).drop("place", "next")


def coherent(rows: DataFrame, gap_pct: float = 0.05, *by: str) -> DataFrame:
    """rows with low and high: quantiles at least a gap around the price, widening with the horizon."""
    gap = F.col("source_price") * gap_pct / 100
    frame = W.partitionBy(*by).orderBy("horizon").rowsBetween(W.unboundedPreceding, 0)
    low, high = F.least("q10", F.col("predicted") - gap), F.greatest("q90", F.col("predicted") + gap)
    own = rows.withColumns({"own_low": F.least(low, high), "own_high": F.greatest(low, high)})
    out = own.withColumns({"low": F.min("own_low").over(frame), "high": F.max("own_high").over(frame)})
    return out.withColumn("adjusted", (F.col("low") != F.col("q10")) | (F.col("high") != F.col("q90"))).drop("own_low", "own_high")


def confidence(edge: Column, coverage: Column, samples: Column, width_pct: Column, drift: Column) -> Column:
    """0 to 100 from edge, coverage, samples and width, times the drift factor."""
    e = F.when(edge == "positive", 1.0).when(edge == "neutral", 0.5).when(edge == "negative", 0.0).otherwise(0.25)
    c = F.greatest(1 - F.abs(coverage - 0.8) / 0.8, F.lit(0.0))
    s = F.least(samples / 100, F.lit(1.0))
    w = F.greatest(1 - width_pct / 100, F.lit(0.0))
    return 100 * (0.35 * e + 0.3 * F.coalesce(c, F.lit(0.0)) + 0.2 * s + 0.15 * F.coalesce(w, F.lit(0.0))) * drift


def confidence_band(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 45, "moderate").otherwise("low")


def abstention(withheld: dict[str, Column], degraded: dict[str, Column], low: dict[str, Column]) -> Column:
    """A struct of state and reasons: withheld before degraded before low before healthy."""
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for part in (withheld, degraded, low) for name, c in part.items()]))
    some = lambda part: F.coalesce(F.greatest(*[F.coalesce(c, F.lit(False)) for c in part.values()], F.lit(False)), F.lit(False))
    return F.struct(F.when(some(withheld), "withheld").when(some(degraded), "degraded").when(some(low), "low_confidence").otherwise("healthy").alias("state"), reasons.alias("reasons"))


def promotion(challengers: DataFrame, least_pairs: int = 32, least_gain: float = 0.0, most_loss: float = 0.05) -> DataFrame:
    """Decisions on (configuration, horizon, pairs, gain, low) rows: a clear loss anywhere rejects, thin or unsure evidence is reviewed."""
    out = challengers.groupBy("configuration").agg(
        F.min("pairs").alias("least_pairs"), F.min("gain").alias("worst_gain"), F.avg("gain").alias("mean_gain"), F.min("low").alias("worst_low"), F.count("*").alias("horizons")
    )
    decision = (
        F.when(F.col("worst_gain") < -most_loss, "reject").when(F.col("least_pairs") < least_pairs, "insufficient").when((F.col("mean_gain") > least_gain) & (F.col("worst_low") > 0), "promote").when(F.col("mean_gain") > least_gain, "review").otherwise("keep")
    )
    return out.withColumn("decision", decision)


def consecutive_breaches(checks: DataFrame, limit: int, *by: str) -> DataFrame:
    """checks (at, breach) with run, the breaches in a row up to each, and whether that is time to roll back."""
    order = W.partitionBy(*by).orderBy("at")
    parted = checks.withColumn("ended", F.sum((~F.col("breach")).cast("int")).over(order))
    run = F.sum(F.col("breach").cast("int")).over(W.partitionBy(*by, "ended").orderBy("at"))
    return parted.withColumn("run", run).withColumn("rollback", F.col("run") >= limit).drop("ended")
