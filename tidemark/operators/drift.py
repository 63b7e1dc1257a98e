"""Drift of errors and of features between the last rows and those before, and a log of its events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.candles import middle
from tidemark.operators.evaluate import newest_rows
from tidemark.operators.store import first_writes


@dataclass(frozen=True)
class Thresholds:
    """From where on a shift, a distance and a loss of direction warn, and from where on they are severe."""

    shift: tuple[float, float] = (2.0, 3.5)
    ks: tuple[float, float] = (0.35, 0.55)
    direction: tuple[float, float] = (0.15, 0.25)


def graded(value: Column, levels: tuple[float, float]) -> Column:
    """0, 1 or 2 for none, warning and severe."""
    return F.when(value >= levels[1], 2).when(value >= levels[0], 1).otherwise(0)


def severity(grade: Column) -> Column:
    return F.when(grade == 2, "severe").when(grade == 1, "warning").otherwise("none")


def two_windows(rows: DataFrame, value: str, at: str, recent: int, before: int, *by: str) -> DataFrame:
    """Of each group with enough rows: medians of both windows, the robust shift, and the Kolmogorov-Smirnov distance.

    The scale of the shift is 1.4826 times the median absolute deviation of the
    earlier window, but a tenth of its median at least. Only recent + before
    rows of a group enter, so its arrays are bounded.
    """
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("origin_at", F.col(at))
    last = newest_rows(known, recent + before, *by).withColumn("new", F.col("back") <= recent)
    kept = lambda new: F.sort_array(F.collect_list(F.when(F.col("new") == new, F.col(value))))
    both = last.groupBy(*by).agg(kept(True).alias("x"), kept(False).alias("y")).where((F.size("x") == recent) & (F.size("y") == before))
    return compared_windows(both).select(*by, "median_before", "median_recent", "shift", "ks")


def compared_windows(rows: DataFrame) -> DataFrame:
    """rows (x and y, the sorted values of the recent and the earlier window) with their medians, the robust shift and the distance."""
    both = rows.withColumns({"median_before": middle(F.col("y")), "median_recent": middle(F.col("x"))})
    mad = middle(F.sort_array(F.transform("y", lambda v: F.abs(v - F.col("median_before")))))
    scale = F.greatest(1.4826 * mad, 0.1 * F.abs("median_before"), F.lit(1e-6))
    below = lambda name, v: F.size(F.filter(name, lambda u: u <= v)) / F.size(name)
    ks = F.array_max(F.transform(F.concat("x", "y"), lambda v: F.abs(below("x", v) - below("y", v))))
    shift = F.abs(F.col("median_recent") - F.col("median_before")) / scale
    return both.withColumns({"shift": F.round(shift, 6), "ks": F.round(ks, 6)})


def distribution_grade(limits: Thresholds) -> Column:
    return F.greatest(graded(F.col("shift"), limits.shift), graded(F.col("ks"), limits.ks))


def feature_drift(features: DataFrame, names: list[str], at: str = "ts", recent: int = 12, before: int = 36, limits: Thresholds = Thresholds(), *by: str) -> DataFrame:
    """(by, feature, metrics, severity): each feature's own last finite values."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names]))
    long = features.select(*by, at, each.alias("f")).select(*by, at, "f.feature", "f.value").where(F.abs("value") < float("inf"))
    out = two_windows(long, "value", at, recent, before, *by, "feature")
    return out.withColumn("severity", severity(distribution_grade(limits)))


def error_drift(rows: DataFrame, recent: int = 8, before: int = 24, limits: Thresholds = Thresholds(), *by: str) -> DataFrame:
    """The severest of the shifts of absolute and signed errors and of the loss of direction, by target time."""
    known = rows.where("abs_pct IS NOT NULL AND signed_pct IS NOT NULL")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("errors"), F.col(f"{k}_pct").alias("value")) for k in ("abs", "signed")]))
    long = known.select(*by, "target_at", each.alias("e")).select(*by, "target_at", "e.*")
    found = two_windows(long, "value", "target_at", recent, before, *by, "errors").withColumn("grade", distribution_grade(limits))
    one = lambda kind, c: F.max(F.when(F.col("errors") == kind, F.col(c)))
    wide = found.groupBy(*by).agg(*[one(k, c).alias(f"{k}_{c}") for k in ("abs", "signed") for c in ("median_before", "median_recent", "shift", "ks")], F.max("grade").alias("grade"))
    last = newest_rows(known.withColumn("origin_at", F.col("target_at")), recent + before, *by)
    hits = lambda new: F.avg(F.when((F.col("back") <= recent) == new, F.col("direction_correct")))
    lost = last.groupBy(*by).agg(F.greatest(F.coalesce(hits(False) - hits(True), F.lit(0.0)), F.lit(0.0)).alias("direction_drop"))
    out = wide.join(lost, list(by))
    return out.withColumn("severity", severity(F.greatest("grade", graded(F.col("direction_drop"), limits.direction)))).drop("grade")


def adaptive_confidence(severity_: Column) -> Column:
    """How far adaptive weights are trusted: fully, by half, or not at all."""
    return F.when(severity_ == "severe", 0.0).when(severity_ == "warning", 0.5).otherwise(1.0)


def drift_events(signals: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Signals (origin_at, signal_key, severity) to append: only warnings and severe ones, each once for an origin."""
    loud = signals.where(F.col("severity").isin("warning", "severe") & (F.col("signal_key") != ""))
    return first_writes(loud, stored, ["origin_at", "signal_key", "severity"], [F.col("signal_key")])
