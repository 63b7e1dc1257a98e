"""Reports on two providers, alerts on them, and assertions that a run may rely on."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators import candles


def reconciliation(primary: DataFrame, secondary: DataFrame, policy: candles.GapPolicy = candles.GapPolicy()) -> DataFrame:
    """One row a series: what both have, where they differ, gaps, silent fills, what would be filled, and the policy's action."""
    count = lambda df, name: df.groupBy("series").agg(F.count("*").alias(name))
    runs = candles.missing_runs(primary, policy)
    decisions = candles.gap_decisions(primary, secondary, policy)
    parts = [
        candles.overlap_report(primary, secondary, policy).select("series", F.col("common").alias("overlapping"), "divergent", F.col("status").alias("overlap_status")),
        runs.groupBy("series").agg(F.count("*").alias("gaps_detected"), F.sum("missing").alias("missing_candles_total")),
        count(candles.missing_runs(secondary, policy), "secondary_gaps"),
        count(candles.silent_fills(primary, secondary, policy), "silent_fill_candidates"),
        decisions.groupBy("series").agg(
            *[F.count_if(F.col("action") == a).alias(f"{a}_gaps") for a in ("fill", "degrade", "withhold")], F.sum(F.when(F.col("action") == "fill", F.col("missing")).otherwise(0)).alias("filled_candles")
        ),
    ]
    every = primary.select("series").union(secondary.select("series")).distinct()
    out = reduce(lambda a, b: a.join(b, "series", "left"), parts, every)
    out = out.fillna(0, [c for c, kind in out.dtypes if kind == "bigint"]).fillna("insufficient", ["overlap_status"])
    state = F.when(F.col("withhold_gaps") > 0, "withhold").when(F.col("degrade_gaps") > 0, "degrade").when(F.col("fill_gaps") > 0, "fill").otherwise("none")
    return out.withColumn("policy_action", state)


def threshold_alerts(report: DataFrame, limits: Mapping[str, tuple[int, int]], key: str, withheld: Column | None = None, gaps: str = "withhold_gaps") -> DataFrame:
    """(key, metric, value, level, threshold): metrics that reach their warning or critical count, the severer one only.

    A warning count of 0 gives no warnings. withheld: whether the policy
    withholds the forecast; where it does, or gaps that withhold it are counted,
    and these raised no alert of their own, forecast_withheld is critical.
    """
    metric = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value"), F.lit(w).cast("long").alias("warn"), F.lit(c).cast("long").alias("critical")) for m, (w, c) in limits.items()]
    fires = lambda m: (m["value"] >= m["critical"]) | ((m["warn"] > 0) & (m["value"] >= m["warn"]))
    fired = F.filter(F.array(*metric), fires)
    if withheld is not None:
        count = F.coalesce(F.col(gaps).cast("long"), F.lit(0).cast("long"))
        own = F.struct(F.lit("forecast_withheld").alias("metric"), F.greatest(count, F.lit(1).cast("long")).alias("value"), F.lit(0).cast("long").alias("warn"), F.lit(limits[gaps][1]).cast("long").alias("critical"))
        silent = (F.coalesce(withheld, F.lit(False)) | (count > 0)) & ~F.exists(fired, lambda m: m["metric"] == gaps)
        fired = F.when(silent, F.concat(fired, F.array(own))).otherwise(fired)
    out = report.select(key, F.explode(fired).alias("m")).select(key, "m.*")
    critical = (F.col("value") >= F.col("critical")) | (F.col("metric") == "forecast_withheld")
    return out.select(key, "metric", "value", F.when(critical, "critical").otherwise("warning").alias("level"), F.when(critical, F.col("critical")).otherwise(F.col("warn")).alias("threshold"))


def overall_level(alerts: DataFrame, key: str, every: DataFrame) -> DataFrame:
    """(key, level, alerts) of every key: ok where no alert fired."""
    found = alerts.groupBy(key).agg(F.max((F.col("level") == "critical").cast("int")).alias("__worst"), F.count("*").alias("alerts"))
    level = F.when(F.col("__worst") == 1, "critical").when(F.col("__worst") == 0, "warning").otherwise("ok")
    return every.select(key).distinct().join(found, key, "left").select(key, level.alias("level"), F.coalesce("alerts", F.lit(0).cast("long")).alias("alerts"))


def selected_source(primary: DataFrame, secondary: DataFrame, failing: list[str], now: Column, policy: candles.GapPolicy = candles.GapPolicy()) -> DataFrame:
    """(series, source, reason): the provider to read each series from.

    A provider is unhealthy if a candle of it breaks one of the failing rules or
    it has none. Two that disagree where both have candles give no source,
    however healthy either is. An unhealthy primary that has candles is replaced
    only by a healthy secondary that was compared with it on enough of them; one
    without any candle by any healthy secondary.
    """
    every = primary.select("series").union(secondary.select("series")).distinct()
    for name, side in (("primary", primary), ("secondary", secondary)):
        bad = candles.validate(side, now).where(F.col("code").isin(failing)).groupBy("series").agg(F.sum("rows").alias(f"bad_{name}"))
        have = side.groupBy("series").agg(F.count("*").alias(f"rows_{name}"))
        every = every.join(have, "series", "left").join(bad, "series", "left")
    both = every.join(candles.overlap_report(primary, secondary, policy).select("series", "status"), "series", "left")
    well = {n: (F.coalesce(f"rows_{n}", F.lit(0)) > 0) & (F.coalesce(f"bad_{n}", F.lit(0)) == 0) for n in ("primary", "secondary")}
    agree, differ = F.coalesce(F.col("status") == "agree", F.lit(False)), F.coalesce(F.col("status") == "divergent", F.lit(False))
    outage = F.coalesce("rows_primary", F.lit(0)) == 0
    reason = (
        F.when(differ, "providers_disagree")
        .when(well["primary"], "primary_healthy")
        .when(well["secondary"] & outage, "primary_outage")
        .when(well["secondary"] & agree, "failover")
        .when(well["secondary"], "failover_without_agreement")
        .otherwise("none_healthy")
    )
    source = F.when(F.col("reason") == "primary_healthy", "primary").when(F.col("reason").isin("failover", "primary_outage"), "secondary")
    return both.withColumn("reason", reason).withColumn("source", source).select("series", "source", "reason")


def lookahead_violations(rows: DataFrame, origin: str, cutoffs: list[str]) -> DataFrame:
    """Rows that used something known only after their origin, with the cutoffs that are too late or unknown."""
    late = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c) > F.col(origin), F.lit(True)), F.lit(c)) for c in cutoffs]))
    return rows.withColumn("late", late).where(F.size("late") > 0)


def origins_apart(one: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """(side, key): origins, as often as they come, that only one of two runs has; none if they are identical."""
    left, right = one.select(*key), other.select(*key)
    return left.exceptAll(right).withColumn("side", F.lit("one")).unionByName(right.exceptAll(left).withColumn("side", F.lit("other")))


def explorer(rows: DataFrame, horizon: int | None, since: Column | None, text: str, sort: str) -> DataFrame:
    """rows filtered by horizon, age and a text without regard to case, in one of three orders."""
    out = rows if horizon is None else rows.where(F.col("horizon") == horizon)
    out = out if since is None else out.where(F.col("origin_at") >= since)
    if text:
        shown = F.lower(F.concat_ws(" ", F.col("origin_at").cast("string"), "regime", "status", F.col("horizon").cast("string")))
        out = out.where(shown.contains(text.lower()))
    orders = {
        "horizon": [F.desc("horizon"), F.desc("origin_at")],
        "error": [F.asc_nulls_last("abs_pct")],
        "newest": [F.desc("origin_at"), F.desc("horizon")],
    }
    return out.orderBy(*orders[sort])


def rolling_metrics(rows: DataFrame, value: str, window: int, *by: str) -> DataFrame:
    """rows with rolling, the mean of the known values among the last so many rows, and known, their number."""
    frame = W.partitionBy(*by).orderBy("origin_at").rowsBetween(-(window - 1), 0)
    return rows.withColumns({"rolling": F.avg(value).over(frame), "known": F.count(value).over(frame)})


def latency_p95(requests: DataFrame, value: str, at: str, newest: int = 1000, *by: str) -> DataFrame:
    """The value at place floor(0.95 n), counted from 1 but at least the first, of the newest requests of each group."""
    nth = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(at), F.desc(value)))
    last = requests.withColumn("nth", nth).where(F.col("nth") <= newest)
    kept = last.groupBy(*by).agg(F.count("*").alias("requests"), F.sort_array(F.collect_list(value)).alias("values"))  # `newest` at most
    at_ = F.greatest(F.floor(F.size("values") * 0.95).cast("int"), F.lit(1))
    return kept.select(*by, "requests", F.element_at("values", at_).alias("p95"))


def degraded(origins: DataFrame, source: DataFrame, key: list[str], values: list[str], age: Column, most_hours: float) -> DataFrame:
    """origins with a source's values, null where it has none or they are too old, and quality saying which."""
    both = origins.join(source.withColumn("__there", F.lit(True)), key, "left")
    quality = F.when(F.col("__there").isNull(), "unavailable").when(age > most_hours, "stale").when(reduce(lambda a, b: a | b, [F.col(v).isNull() for v in values]), "partial").otherwise("ok")
    out = both.withColumn("quality", quality)
    return out.withColumns({v: F.when(F.col("quality").isin("ok", "partial"), F.col(v)) for v in values}).drop("__there")


def first_positive(*values: Column) -> Column:
    """The first of the values that is finite and above 0."""
    return F.coalesce(*[F.when((v > 0) & (v < float("inf")) & ~F.isnan(v), v) for v in values])


def feature_groups(features: Column, prefixes: Mapping[str, list[str]], rest: str) -> Column:
    """A map of group to sorted names of a map's keys, by the first group that has a prefix of theirs; empty groups are left out."""
    name = lambda k: reduce(lambda rest_, g: F.when(reduce(lambda a, b: a | b, [k.startswith(p) for p in g[1]]), g[0]).otherwise(rest_), reversed(prefixes.items()), F.lit(rest))
    keys = F.array_sort(F.map_keys(features))
    groups = F.array(*[F.lit(g) for g in (*prefixes, rest)])
    listed = F.map_from_arrays(groups, F.transform(groups, lambda g: F.filter(keys, lambda k: name(k) == g)))
    return F.map_filter(listed, lambda _, names: F.size(names) > 0)
