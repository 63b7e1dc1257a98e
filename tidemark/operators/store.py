"""Stored forecasts: first write wins, outcomes fill in later, and audits of both.

Tables are appended to, never updated: outcomes are a table of their own that
is joined at reading, so an insert is an anti-join and a repeated run adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

KEY = ["series", "origin_at", "model", "horizon"]


def first_writes(incoming: DataFrame, existing: DataFrame | None, key: list[str], order: list[Column]) -> DataFrame:
    """The incoming rows to append: of each key the first by order, if the key isn't stored."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    first = incoming.withColumn("__nth", rank).where("__nth = 1").drop("__nth")
    return first if existing is None else first.join(existing.select(*key), key, "left_anti")


def keep_last(rows: DataFrame, key: list[str], order: Column, newest: int | None = None, of: list[str] | None = None) -> DataFrame:
    """Of each key the last row by order; optionally the newest so many of each group of `of`."""
    last = rows.withColumn("__nth", F.row_number().over(W.partitionBy(*key).orderBy(order.desc()))).where("__nth = 1")
    if newest is not None:
        last = last.withColumn("__nth", F.row_number().over(W.partitionBy(*(of or [])).orderBy(order.desc()))).where(F.col("__nth") <= newest)
    return last.drop("__nth")


def mature(pending: DataFrame, candles: DataFrame, now: Column) -> DataFrame:
    """Outcomes of pending forecasts whose exact target candle is there, closed by now and positive."""
    actual = candles.where(F.col("close") > 0).select("series", F.col("ts").alias("target_at"), F.col("close").alias("actual"))
    due = pending.where(F.col("target_at") <= now).join(actual, ["series", "target_at"])
    return due.select(*KEY, "target_at", "actual", F.col("target_at").alias("matured_at"))


def orphans(predictions: DataFrame, origins: DataFrame) -> DataFrame:
    """Predictions without an origin."""
    return predictions.join(origins.select("series", "origin_at"), ["series", "origin_at"], "left_anti")


def origins_without(predictions: DataFrame, origins: DataFrame, model: str) -> DataFrame:
    """Origins that have predictions, but none of a model."""
    known = origins.join(predictions.select("series", "origin_at"), ["series", "origin_at"], "left_semi")
    return known.join(predictions.where(F.col("model") == model).select("series", "origin_at"), ["series", "origin_at"], "left_anti")


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def nested(predictions: DataFrame) -> DataFrame:
    """One document an origin: model to horizon to price and quantiles."""
    by_model = predictions.groupBy("series", "origin_at", "model").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat(F.col("horizon").cast("string"), F.lit("h")).alias("k"), F.struct("predicted", "q10", "q90").alias("v"))))).alias("h"))
    return by_model.groupBy("series", "origin_at").agg(F.map_from_entries(F.collect_list(F.struct("model", "h"))).alias("predictions"))


def flattened(documents: DataFrame) -> DataFrame:
    """nested() undone."""
    models = documents.select("series", "origin_at", F.explode("predictions").alias("model", "h"))
    return models.select("series", "origin_at", "model", F.explode("h").alias("k", "v")).select("series", "origin_at", "model", F.regexp_extract("k", "^([0-9]+)h$", 1).cast("int").alias("horizon"), "v.*")


def current_decisions(log: DataFrame, key: str, decision: str, at: str) -> DataFrame:
    """The newest decision of each key from an append-only log, and the number of decisions."""
    return log.groupBy(key).agg(F.max_by(decision, F.struct(at, decision)).alias(decision), F.count("*").alias("decisions"))


def error_budget(events: DataFrame, good: Column, objective: float, *by: str) -> DataFrame:
    """Successes and failures against an objective: the share that is left of the failures it allows."""
    out = events.groupBy(*by).agg(F.count("*").alias("events"), F.count_if(good).alias("good"))
    allowed = (1 - objective) * F.col("events")
    out = out.withColumn("budget_left", 1 - (F.col("events") - F.col("good")) / F.nullif(allowed, F.lit(0.0)))
    status = F.when(F.col("events") < 30, "insufficient").when(F.col("budget_left") < 0, "breached").when(F.col("budget_left") < 0.25, "at_risk").otherwise("healthy")
    return out.withColumn("status", status)


def revisions(snapshots: DataFrame, key: list[str], at: str, content: list[str]) -> DataFrame:
    """Snapshots whose content differs from the one before of the same key."""
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    before = F.lag("digest").over(W.partitionBy(*key).orderBy(at))
    marked = snapshots.withColumn("digest", digest).withColumn("before", before)
    return marked.withColumn("revised", F.coalesce(F.col("digest") != F.col("before"), F.lit(False))).drop("before")


def retention(assets: DataFrame, size: str, at: str, most: int, budget: int, *by: str) -> DataFrame:
    """assets with keep: the newest of each group always, then greedily by age under a count and a byte budget.

    A skipped asset uses no budget, so the choice is sequential; it is a fold
    over each group's sizes, whose number the kept history bounds.
    """
    rows = assets.withColumn("nth", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(at))))
    sizes = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("nth", F.col(size).alias("size")))).alias("all"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        take = (x["nth"] == 1) | ((acc["n"] < most) & (acc["used"] + x["size"] <= budget))
        return F.struct(
            F.when(take, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.when(take, acc["used"] + x["size"]).otherwise(acc["used"]).alias("used"),
            F.when(take, F.concat(acc["kept"], F.array(x["nth"]))).otherwise(acc["kept"]).alias("kept"),
        )

    kept = sizes.select(*by, F.aggregate("all", start, step, lambda acc: acc["kept"]).alias("kept"))
    return rows.join(kept, list(by)).withColumn("keep", F.array_contains("kept", F.col("nth"))).drop("nth", "kept")


def non_overlapping(signals: DataFrame, *by: str) -> DataFrame:
    """Signals (origin_at, target_at) chosen first come first served: the next starts at or after the last one's target.

    A fold over each group's ordered signals; groups are series and models.
    """
    ordered = signals.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("origin_at", "target_at"))).alias("all"))
    start = F.struct(F.lit(None).cast("timestamp_ntz").alias("free"), F.array().cast("array<struct<origin_at:timestamp_ntz,target_at:timestamp_ntz>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        take = acc["free"].isNull() | (x["origin_at"] >= acc["free"])
        return F.struct(F.when(take, x["target_at"]).otherwise(acc["free"]).alias("free"), F.when(take, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    return ordered.select(*by, F.inline(F.aggregate("all", start, step, lambda acc: acc["kept"])))


def repaired(stored: DataFrame, recomputed: dict[str, Column], tolerance: float = 1e-6) -> DataFrame:
    """stored with its columns put right where they are missing or off what is recomputed, and whether any was."""
    wrong = {c: F.coalesce(F.abs(F.col(c) - x) > tolerance, F.col(c).isNull() != x.isNull()) for c, x in recomputed.items()}
    out = stored.withColumn("repaired", F.array_contains(F.array(*wrong.values()), True))
    return out.withColumns({c: F.when(wrong[c], x).otherwise(F.col(c)) for c, x in recomputed.items()})


def resolved_features(registry: DataFrame, names: list[str]) -> DataFrame:
    """features, lineage and feature_set of some names of a registry (name, version, source); an unknown name raises."""
    wanted = registry.sparkSession.createDataFrame([(n,) for n in names], "name string")
    found = wanted.join(registry, "name", "left")
    sure = F.when(F.col("version").isNull(), F.raise_error(F.concat(F.lit("unknown feature "), "name"))).otherwise(F.concat_ws(":", "name", F.col("version").cast("string"), "source"))
    out = found.agg(F.count("*").alias("features"), F.array_join(F.array_sort(F.collect_list(sure)), ",").alias("lineage"))  # as many as are named
    return out.withColumn("feature_set", F.sha2("lineage", 256))
