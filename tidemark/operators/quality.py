"""Audits, identities, freshness, contracts and finer features."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions import scalars


def history_audit(stored: DataFrame, recomputed: DataFrame, key: list[str], values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(check, rows): rows of either side without the other, and values that differ beyond a tolerance."""
    a = stored.select(*key, F.lit(1).alias("in_a"), *[F.col(v).alias(f"{v}_a") for v in values])
    b = recomputed.select(*key, F.lit(1).alias("in_b"), *[F.col(v).alias(f"{v}_b") for v in values])
    both = a.join(b, key, "full")

    def differs(v: str) -> Column:
        x, y = F.col(f"{v}_a").cast("double"), F.col(f"{v}_b").cast("double")
        return F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & ((x.isNull() != y.isNull()) | (F.abs(x - y) > tolerance * F.greatest(F.lit(1.0), F.abs(y))))

    checks = {"missing": F.col("in_a").isNull(), "unexpected": F.col("in_b").isNull(), **{f"{v}_differs": differs(v) for v in values}}
    wide = both.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("rows")) for name in checks])))


def identity(rows: DataFrame, order: list[str], *by: str) -> DataFrame:
    """A digest of each group's rows in order: the SHA-256 of its rows' digests, each of canonical JSON.

    Digests of rows, not rows, are gathered; a group is a series.
    """
    digest = F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256)
    gathered = rows.withColumn("digest", digest).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, "digest"))).alias("d"), F.count("*").alias("rows"))
    return gathered.select(*by, "rows", F.sha2(F.concat_ws("", F.col("d.digest")), 256).alias("identity"))


def freshness(rows: DataFrame, at: str, now: Column, warn_seconds: int, stale_seconds: int, *by: str) -> DataFrame:
    """Age of each group's newest row, and fresh, late or stale."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("newest").cast("timestamp"))
    out = rows.groupBy(*by).agg(F.max(at).alias("newest")).withColumn("age_seconds", age)
    return out.withColumn("state", F.when(F.col("age_seconds").isNull(), "unknown").when(F.col("age_seconds") <= warn_seconds, "fresh").when(F.col("age_seconds") <= stale_seconds, "late").otherwise("stale"))


def source_health(snapshots: DataFrame, now: Column, stale_hours: float, expected: list[str]) -> DataFrame:
    """snapshots (source, at, features map) with issues and whether to quarantine: stale, missing or non-finite features."""
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("at").cast("timestamp"))) / 3600
    names = F.array(*map(F.lit, expected))
    missing = F.size(F.array_except(names, F.map_keys("features"))) > 0
    broken = F.exists(F.map_values("features"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    issues = F.array_compact(F.array(F.when(age > stale_hours, F.lit("stale")), F.when(missing, F.lit("incomplete")), F.when(broken, F.lit("non_finite"))))
    return snapshots.withColumn("issues", issues).withColumn("quarantined", F.size("issues") > 0)


def missingness(rows: DataFrame, features: list[str], *by: str) -> DataFrame:
    """(by, feature, rows, missing): how often each feature is null or not finite."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    long = rows.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), bad(c).alias("bad")) for c in features])))
    return long.groupBy(*by, "feature").agg(F.count("*").alias("rows"), F.count_if("bad").alias("missing"))


def age_curve(rows: DataFrame, edges: list[float], least: int, *by: str) -> DataFrame:
    """rows (age_hours, abs_pct) as means by age band, and null means where samples are few."""
    band = F.lit(0)
    for e in edges:
        band = band + (F.col("age_hours") >= e).cast("int")
    out = rows.withColumn("band", band).groupBy(*by, "band").agg(F.count("*").alias("samples"), F.avg("abs_pct").alias("mean"))
    return out.withColumn("mean", F.when(F.col("samples") >= least, F.col("mean")))


def age_threshold(curve: DataFrame, edges: list[float], tolerance: float, *by: str) -> DataFrame:
    """The largest age up to which a curve's means stay within a tolerance of the youngest band's."""
    first = F.first("mean").over(W.partitionBy(*by).orderBy("band").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    good = F.coalesce(F.col("mean") <= F.col("base") * (1 + tolerance), F.lit(False))
    upto = F.min(good.cast("int")).over(W.partitionBy(*by).orderBy("band"))
    limits = F.array(*[F.lit(float(e)) for e in [*edges, math.inf]])
    marked = curve.withColumn("base", first).withColumn("ok", upto)
    return marked.groupBy(*by).agg(F.max(F.when(F.col("ok") == 1, F.element_at(limits, F.col("band") + 1))).alias("fresh_until"))


def contract_violations(rows: DataFrame) -> DataFrame:
    """Forecast rows with the rules that each breaks."""
    rules = {
        "price_not_positive": ~(F.col("predicted") > 0), "quantiles_crossed": F.col("q10") > F.col("q90"), "price_outside": (F.col("predicted") < F.col("q10")) | (F.col("predicted") > F.col("q90")),
        "target_not_after_origin": F.col("target_at") <= F.col("origin_at"), "horizon_unknown": ~F.col("horizon").isin(2, 4, 8, 16), "price_missing": F.col("predicted").isNull(),
    }
    return rows.withColumn("violations", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])))


def resource(rows: DataFrame) -> DataFrame:
    """Flat forecast rows as nested resources."""
    outcome = F.when(F.col("actual").isNotNull(), F.struct("actual", "abs_pct", "direction_correct"))
    return rows.select(
        F.concat_ws("/", "series", F.date_format("origin_at", "yyyyMMddHH"), "model", F.col("horizon").cast("string")).alias("id"),
        F.struct("origin_at", "target_at", "horizon").alias("time"), F.struct("predicted", "q10", "q90").alias("forecast"), outcome.alias("outcome"),
    )


def cursor(filters: Column, key: Column) -> Column:
    """An opaque cursor: URL-safe base64 of the JSON of filters and key."""
    return F.rtrim(F.translate(F.base64(F.to_json(F.struct(filters.alias("filters"), key.alias("key"))).cast("binary")), "+/\r\n", "-_"), F.lit("="))


def read_cursor(value: Column, schema: str) -> Column:
    return F.from_json(F.unbase64(F.translate(value, "-_", "+/")).cast("string"), schema)


def fine_features(fine: DataFrame, bars: int = 12) -> DataFrame:
    """Volatility, momentum, range, volume slope and close position over the last finer bars of each."""
    order = W.partitionBy("series").orderBy("ts")
    last = order.rowsBetween(-(bars - 1), 0)
    ret = F.log("close") - F.log(F.lag("close").over(order))
    rows = fine.where("close > 0").withColumns({"ret": ret, "k": F.row_number().over(order).cast("double"), "log_volume": F.log1p(F.col("volume").cast("double")), "first_close": F.first("close").over(last)})
    slope = F.covar_pop("k", "log_volume").over(last) / F.nullif(F.var_pop("k").over(last), F.lit(0.0))
    width = F.max("high").over(last) - F.min("low").over(last)
    return rows.select(
        "series", "ts", F.coalesce(F.stddev_samp("ret").over(last) * 100, F.lit(0.0)).alias("volatility"), ((F.col("close") / F.col("first_close") - 1) * 100).alias("momentum"),
        (width / F.col("close") * 100).alias("range_pct"), F.coalesce(slope, F.lit(0.0)).alias("volume_slope"), F.coalesce((F.col("close") - F.min("low").over(last)) / F.nullif(width, F.lit(0.0)), F.lit(0.5)).alias("close_position"),
    )


def alternatives(rows: DataFrame, left: str, right: str, key: list[str]) -> DataFrame:
    """(gate, rows) of pairing two models' attempts: duplicates, missing partners, outcomes that disagree, and pairs."""
    one = lambda m, t: rows.where(F.col("model") == m).groupBy(*key).agg(F.count("*").alias(f"n_{t}"), F.max("actual").alias(f"actual_{t}"))
    both = one(left, "l").join(one(right, "r"), key, "full")
    has = F.col("n_l").isNotNull() & F.col("n_r").isNotNull()
    gates = {
        "duplicate": (F.coalesce("n_l", F.lit(0)) > 1) | (F.coalesce("n_r", F.lit(0)) > 1), "missing_partner": ~has,
        "outcome_mismatch": has & (F.abs(F.col("actual_l") - F.col("actual_r")) > 1e-9), "paired": has & F.col("actual_l").isNotNull(),
    }
    wide = both.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in gates.items()])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).alias("rows")) for n in gates])))


def stacked_weights(rows: DataFrame, models: list[str], *by: str, steps: int = 400, rate: float = 0.1) -> DataFrame:
    """(by, model, weight): simplex weights of predicted changes with the least squared error, by projected gradient.

    The gradient needs only second moments, which are aggregated in Spark; a
    fit then sees one small matrix a group, whatever the rows.
    """
    wide = rows.where(F.col("predicted_change_pct").isNotNull() & F.col("actual_change_pct").isNotNull()).groupBy(*by, "series", "origin_at").pivot("model", models).agg(F.first("predicted_change_pct"))
    actual = rows.groupBy(*by, "series", "origin_at").agg(F.first("actual_change_pct").alias("y"))
    both = wide.join(actual, [*by, "series", "origin_at"]).where(" AND ".join(f"`{m}` IS NOT NULL" for m in models) + " AND y IS NOT NULL")
    moments = [F.avg(F.col(a) * F.col(b)).alias(f"{a}|{b}") for k, a in enumerate(models) for b in [*models[k:], "y"]]
    gathered = both.groupBy(*by).agg(*moments)

    def fit(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                g = np.array([[row.get(f"{a}|{b}", row.get(f"{b}|{a}")) for b in models] for a in models], float)
                c = np.array([row[f"{a}|y"] for a in models], float)
                w, step = np.full(len(models), 1 / len(models)), rate / max(np.trace(g), 1e-12)
                for _ in range(steps):
                    w = w - step * len(models) * (g @ w - c)
                    u = np.sort(w)[::-1]
                    cut = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
                    w = np.maximum(w - cut[np.flatnonzero(u > cut)[-1]], 0)
                out += [(*[row[k] for k in by], m, float(x)) for m, x in zip(models, w)]
            yield pd.DataFrame(out, columns=[*by, "model", "weight"])

    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in gathered.select(*by).schema], "model string, weight double"])
    return gathered.mapInPandas(fit, shape)


def two_sample(rows: DataFrame, value: str, group: str, one: str, other: str, *by: str) -> DataFrame:
    """Welch's statistic of two groups' means from aggregates, and its two-sided normal p-value."""
    part = lambda name, t: [F.count_if((F.col(group) == name) & F.col(value).isNotNull()).alias(f"n_{t}"), F.avg(F.when(F.col(group) == name, F.col(value))).alias(f"mean_{t}"), F.var_samp(F.when(F.col(group) == name, F.col(value))).alias(f"var_{t}")]
    out = rows.groupBy(*by).agg(*part(one, "a"), *part(other, "b"))
    z = (F.col("mean_a") - F.col("mean_b")) / F.nullif(F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b")), F.lit(0.0))
    return out.withColumn("z", z)


def two_sided_p(z: str) -> Column:
    """The normal tail beyond |z| on both sides."""

    def tail(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)))

    tail.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(tail, "double")(F.col(z))


def replay(rows: DataFrame, configurations: DataFrame, window: int, *by: str) -> DataFrame:
    """Configurations (configuration, decay, floor) replayed at every origin: weights from errors of matured rows before it.

    A model's weight at an origin is exp(-decay x its mean error over up to
    `window` earlier rows, a horizon back), at least the floor. One window gives
    the past of all origins at once; nothing is looped.
    """
    past = W.partitionBy("series", "model", *by).orderBy("origin_at").rowsBetween(-window - 16, -17)
    known = rows.where("actual IS NOT NULL AND predicted > 0").withColumn("past", F.avg("abs_pct").over(past))
    dealt = known.where("past IS NOT NULL").crossJoin(F.broadcast(configurations))  # a few configurations
    w = F.greatest(F.exp(-F.col("decay") * F.col("past") / 100), F.col("floor"))
    blended = dealt.withColumn("w", w).groupBy("configuration", "series", "origin_at", *by).agg(F.exp(F.sum(F.col("w") * F.log("predicted")) / F.sum("w")).alias("price"), F.first("actual").alias("actual"))
    error = scalars.abs_error_pct(F.col("price"), F.col("actual"))
    return blended.groupBy("configuration", *by).agg(F.count("*").alias("origins"), F.avg(error).alias("mae_pct"))
