"""Evaluation of scored forecasts: summaries, pairs, segments, drift and probabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions import scalars

METRICS = ("samples", "mae_pct", "bias_pct", "direction_accuracy", "coverage")


def metrics() -> list[Column]:
    """Null-skipping means over scored rows, as aggregates."""
    return [
        F.count("abs_pct").alias("samples"), F.avg("abs_pct").alias("mae_pct"), F.avg("signed_pct").alias("bias_pct"),
        F.avg("direction_correct").alias("direction_accuracy"), F.avg(F.col("within").cast("int")).alias("coverage"),
    ]


def summary(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*metrics())


def evidence_grid(rows: DataFrame, dimensions: dict[str, list], low: int = 30) -> DataFrame:
    """The summary of every cell of the dimensions, empty ones too, with whether its samples are few.

    The grid is made of the dimensions' values, which are few and given.
    """
    spark = rows.sparkSession
    grid = reduce(DataFrame.crossJoin, [spark.createDataFrame([(v,) for v in values], [name]) for name, values in dimensions.items()])
    found = grid.join(summary(rows, *dimensions), list(dimensions), "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    return found.withColumn("warning", F.when(F.col("samples") == 0, "no_samples").when(F.col("samples") < low, "low_samples"))


def windows_report(rows: DataFrame, now: Column, days: list[int], *by: str) -> DataFrame:
    """Summaries over all time and the last so many days, in one shuffle: a row counts in each window that it lies in."""
    inside = [F.when(F.col("origin_at") >= now - F.make_dt_interval(F.lit(d)), F.lit(f"{d}d")) for d in days]
    return rows.withColumn("window", F.explode(F.array_compact(F.array(F.lit("all"), *inside)))).groupBy("window", *by).agg(*metrics())


def segments(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Summaries overall and by each dimension alone, by grouping sets."""
    wide = rows.select("abs_pct", "signed_pct", "direction_correct", "within", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("segment")) for d in dimensions], F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("segment")))).alias("s"))
    return wide.groupBy("s.dimension", "s.segment").agg(*metrics())


def pairs(rows: DataFrame, candidate: str, baseline: str) -> DataFrame:
    """One row for each origin and target that both models forecast with the same known outcome."""
    one = lambda name, tag: rows.where((F.col("model") == name) & F.col("actual").isNotNull()).select(
        "series", "origin_at", "horizon", "target_at", *[F.col(c).alias(f"{c}_{tag}") for c in ("actual", "abs_pct", "direction_correct", "predicted", "predicted_change_pct")]
    )
    both = one(candidate, "c").join(one(baseline, "b"), ["series", "origin_at", "horizon", "target_at"])
    return both.where(F.col("actual_c") == F.col("actual_b"))


def skill(paired: DataFrame, *by: str, neutral: float = 0.02) -> DataFrame:
    """1 less the candidate's mean error over the baseline's, and a verdict."""
    out = paired.groupBy(*by).agg(F.count("*").alias("pairs"), F.avg("abs_pct_c").alias("mae_candidate"), F.avg("abs_pct_b").alias("mae_baseline"))
    out = out.withColumn("skill", 1 - F.col("mae_candidate") / F.nullif(F.col("mae_baseline"), F.lit(0.0)))
    state = F.when(F.col("skill") > neutral, "positive").when(F.col("skill") < -neutral, "negative").otherwise("neutral")
    return out.withColumn("edge", F.when(F.col("skill").isNull(), "unknown").otherwise(state))


def confusion(rows: DataFrame, neutral_pct: float, *by: str) -> DataFrame:
    """Counts of predicted by actual direction."""
    return (
        rows.where("actual IS NOT NULL")
        .withColumns({"said": scalars.direction_class(F.col("predicted_change_pct"), neutral_pct), "was": scalars.direction_class(F.col("actual_change_pct"), neutral_pct)})
        .groupBy(*by, "said", "was")
        .agg(F.count("*").alias("rows"))
    )


def precision_recall(counts: DataFrame, *by: str) -> DataFrame:
    """Precision and recall of each direction, and the mean recall over directions that occur."""
    said = counts.groupBy(*by, F.col("said").alias("label")).agg(F.sum("rows").alias("n_said"), F.sum(F.when(F.col("said") == F.col("was"), F.col("rows")).otherwise(0)).alias("right"))
    was = counts.groupBy(*by, F.col("was").alias("label")).agg(F.sum("rows").alias("n_was"))
    both = said.join(was, [*by, "label"], "full").fillna(0, ["n_said", "right", "n_was"])
    both = both.withColumns({"precision": F.col("right") / F.nullif(F.col("n_said"), F.lit(0)), "recall": F.col("right") / F.nullif(F.col("n_was"), F.lit(0))})
    return both.withColumn("balanced_accuracy", F.avg("recall").over(W.partitionBy(*by)))


def economic(rows: DataFrame, threshold_pct: float = 0.15, friction_pct: float = 0.15) -> DataFrame:
    """rows with position, gross and net effect of acting on forecasts beyond a threshold."""
    side = F.when(F.col("predicted_change_pct") > threshold_pct, 1).when(F.col("predicted_change_pct") < -threshold_pct, -1).otherwise(0)
    gross = F.col("position") * F.col("actual_change_pct")
    return rows.where("actual IS NOT NULL").withColumn("position", side).withColumn("gross", gross).withColumn("net", F.when(F.col("position") == 0, 0.0).otherwise(F.col("gross") - friction_pct))


def distributional(rows: DataFrame, *by: str) -> DataFrame:
    """Mean quantile losses, interval scores and widths over the rows that have an interval and outcome."""
    a, lo, mid, hi = (F.col(c) for c in ("actual", "q10", "predicted", "q90"))
    out = rows.where("actual IS NOT NULL AND q10 IS NOT NULL AND q90 IS NOT NULL").groupBy(*by).agg(
        F.count("*").alias("rows"), F.avg(scalars.pinball(a, lo, 0.1)).alias("pinball_10"), F.avg(scalars.pinball(a, mid, 0.5)).alias("pinball_50"),
        F.avg(scalars.pinball(a, hi, 0.9)).alias("pinball_90"), F.avg(scalars.winkler(a, lo, hi, 0.2)).alias("winkler"),
        F.avg(scalars.scaled_interval_score(a, lo, hi, 0.2)).alias("interval_score"), F.avg(scalars.interval_width_pct(lo, hi, F.col("source_price"))).alias("width_pct"),
        F.avg(scalars.within(a, lo, hi).cast("int")).alias("coverage"),
    )
    return out.withColumn("coverage_error", F.abs(F.col("coverage") - 0.8))


def newest_rows(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """The last n rows by origin of each group, with back counting from 1 at the newest."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("origin_at")))
    return rows.withColumn("back", rank).where(F.col("back") <= n)


def causal_quantile(rows: DataFrame, level: float, window: int, least: int, *by: str) -> DataFrame:
    """rows with band: the nearest-rank quantile of the errors of up to `window` rows before, from `least` on."""
    frame = W.partitionBy(*by).orderBy("origin_at").rowsBetween(-window, -1)
    past = F.sort_array(F.collect_list("abs_pct").over(frame))
    at = F.ceil(level * F.size("past")).cast("int")
    return rows.withColumn("past", past).withColumn("band", F.when(F.size("past") >= least, F.try_element_at("past", at))).drop("past")


def conformal(rows: DataFrame, target: float = 0.8, *by: str) -> DataFrame:
    """The multiplier of half-widths at which intervals would have covered the target share, within 0.5 and 3.

    It is the score of one rank, so scores are counted first and then ranked; no group is gathered into an array.
    Intervals without width have no score.
    """
    half = (F.col("q90") - F.col("q10")) / 2
    score = F.abs(F.col("actual") - F.col("predicted")) / F.nullif(half, F.lit(0.0))
    known = rows.where("actual IS NOT NULL AND q10 IS NOT NULL").select(*by, score.alias("score"), "within")
    n = F.col("samples")
    level = F.least(F.lit(1.0), F.ceil((n + 1) * target) / F.nullif(n, F.lit(0)))
    counted = known.groupBy(*by).agg(F.count("score").alias("samples"), F.avg(F.col("within").cast("int")).alias("coverage")).withColumn("at", (F.ceil(level * (n - 1)) + 1).cast("long"))
    ranked = known.where("score IS NOT NULL").withColumn("nth", F.row_number().over(W.partitionBy(*by).orderBy("score"))).select(*[F.col(c).alias(f"__{c}") for c in by], "score", "nth")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.col("nth") == F.col("at"))
    legacy = F.sqrt(target / F.greatest(F.col("coverage"), F.lit(0.1)))
    multiplier = F.when(n >= 20, F.greatest(F.least(F.col("score"), F.lit(3.0)), F.lit(0.5))).when(n >= 10, F.greatest(F.least(legacy, F.lit(1.75)), F.lit(0.75))).otherwise(1.0)
    return counted.join(ranked, same, "left").select(*by, "samples", "coverage", multiplier.alias("multiplier"))


def reliability(rows: DataFrame, probability: Column, outcome: Column, bins: int = 10) -> DataFrame:
    """Mean forecast and rate of each bin, and the expected calibration error over all of them."""
    number = F.least(F.floor(probability * bins), F.lit(bins - 1)).cast("int")
    out = rows.groupBy(number.alias("bin")).agg(F.count("*").alias("rows"), F.avg(probability).alias("mean_forecast"), F.avg(outcome).alias("rate"))
    all_ = W.partitionBy()  # of at most `bins` rows
    gap = F.abs(F.col("mean_forecast") - F.col("rate"))
    return out.withColumns({"ece": F.sum(F.col("rows") * gap).over(all_) / F.sum("rows").over(all_), "max_deviation": F.max(gap).over(all_)})


def adaptive_scores(rows: DataFrame, *by: str) -> DataFrame:
    """A model's score from its matured error, direction, bias and coverage, of each group."""
    out = rows.where("actual IS NOT NULL").groupBy(*by).agg(
        F.count("*").alias("samples"), F.avg("abs_pct").alias("mae"), F.avg("direction_correct").alias("da"), F.avg("signed_pct").alias("bias"),
        F.avg(F.col("within").cast("int")).alias("coverage"), F.count("within").alias("intervals"),
    )
    base = F.exp(-2.5 * F.col("mae") / 100) * (1 + 0.25 * (F.col("da") - 0.5) * 2) * F.exp(-0.35 * F.abs("bias") / 100)
    return out.withColumn("score", base * F.when(F.col("intervals") >= 3, F.exp(-0.35 * F.abs(F.col("coverage") - 0.8))).otherwise(1.0))


def residual_correlations(rows: DataFrame, least: int = 12, *by: str) -> DataFrame:
    """Guarded correlations of residuals of every two models on origins that both forecast."""
    known = rows.where("actual IS NOT NULL").select(*by, "series", "origin_at", "model", "signed_pct")
    other = known.withColumnsRenamed({"model": "other", "signed_pct": "other_pct"})
    both = known.join(other, [*by, "series", "origin_at"]).where("model < other")
    out = both.groupBy(*by, "model", "other").agg(F.count("*").alias("pairs"), scalars.guarded_corr(F.col("signed_pct"), F.col("other_pct")).alias("rho"))
    return out.withColumn("rho", F.when(F.col("pairs") >= least, F.col("rho")))


def keyset_page(rows: DataFrame, keys: list[tuple[str, bool]], after: dict | None, limit: int) -> DataFrame:
    """The page after a key in a total order of (column, descending) pairs; one row more than the limit tells of a next page."""
    if after is not None:
        condition, equal = F.lit(False), F.lit(True)
        for name, descending in keys:
            value = F.lit(after[name])
            condition |= equal & ((F.col(name) < value) if descending else (F.col(name) > value))
            equal &= F.col(name) == value
        rows = rows.where(condition)
    return rows.orderBy(*[F.desc(n) if d else F.asc(n) for n, d in keys]).limit(limit + 1)


def folds(origins: DataFrame, count: int, purge_hours: int, embargo_hours: int, least: int) -> DataFrame:
    """(fold, role, series, ts) of purged walk-forward folds: contiguous validation chunks, each trained on what ended before.

    The first of count + 1 chunks only trains. Training rows of a fold lie at
    least purge + embargo hours before its validation starts.
    """
    order = W.partitionBy("series").orderBy("ts")
    cut = origins.withColumn("chunk", F.ntile(count + 1).over(order) - 1)
    starts = cut.where("chunk > 0").groupBy("series", "chunk").agg(F.min("ts").alias("start"))
    valid = cut.where("chunk > 0").select(F.col("chunk").alias("fold"), F.lit("validate").alias("role"), "series", "ts")
    edge = F.col("start") - F.make_dt_interval(F.lit(0), F.lit(purge_hours + embargo_hours))
    train = origins.select("series", "ts").join(starts, "series").where(F.col("ts") <= edge).select(F.col("chunk").alias("fold"), F.lit("train").alias("role"), "series", "ts")
    enough = train.groupBy("fold", "series").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("fold", "series")
    return train.unionByName(valid).join(enough, ["fold", "series"], "left_semi").select("fold", "role", "series", "ts")


def nested_folds(origins: DataFrame, counts: tuple[int, int], purge_hours: int, embargo_hours: int, least: tuple[int, int]) -> DataFrame:
    """(outer_fold, inner_fold, role, series, ts): folds within the training rows of each outer fold, so that nothing is chosen on its validation rows."""
    outer = folds(origins, counts[0], purge_hours, embargo_hours, least[0]).where("role = 'train'")
    apart = outer.select(F.struct("series", F.col("fold").alias("outer_fold")).alias("series"), "ts")
    inner = folds(apart, counts[1], purge_hours, embargo_hours, least[1])
    return inner.select("series.outer_fold", F.col("fold").alias("inner_fold"), "role", "series.series", "ts")
