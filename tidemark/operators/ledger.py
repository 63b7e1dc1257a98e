"""Frozen cohorts with digests, and append-only logs of changes that rollbacks read and write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.store import first_writes


def frozen_origins(rows: DataFrame, now: Column) -> DataFrame:
    """Rows of the origins whose every target could be known by now: origins of which one is still to come are left out whole."""
    last = F.max("target_at").over(W.partitionBy("series", "origin_at"))
    return rows.withColumn("__last", last).where(F.col("__last") <= now).drop("__last")


def canonical(values: Sequence[str], scale: int = 10_000) -> Column:
    """A row's values as text: numbers as whole multiples of 1/scale, null as nothing, joined by bars."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string") if c in ("series", "model", "horizon") else F.round(F.col(c) * scale).cast("long").cast("string"), F.lit("")) for c in values])


def cohort_digest(rows: DataFrame, key: Sequence[str], values: Sequence[str], at: str = "origin_at") -> DataFrame:
    """(series, rows, first_at, last_at, digest): a digest of each series' rows in the order of time and key.

    Rows are digested, then each day's digests in order, then the days'; so the
    largest list is a day's or that of the days, and the digest is the same
    however the rows are dealt.
    """
    second = F.unix_timestamp(F.col(at).cast("timestamp"))
    one = rows.select("series", at, F.floor(second / 86400).alias("day"), F.struct(second.alias("t"), *[F.col(k) for k in key]).alias("k"), F.sha2(F.concat_ws("|", second.cast("string"), canonical([*key, *values])).cast("binary"), 256).alias("d"))
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x["d"]), "").cast("binary"), 256)
    days = one.groupBy("series", "day").agg(joined(["k", "d"]).alias("d"), F.count("*").alias("n"), F.min(at).alias("low"), F.max(at).alias("high"))
    return days.groupBy("series").agg(F.sum("n").alias("rows"), F.min("low").alias("first_at"), F.max("high").alias("last_at"), joined(["day", "d"]).alias("digest"))


def cohort_evidence(frozen: DataFrame, baseline: str, *by: str) -> DataFrame:
    """(model, by, attempts, failures, exact, paired, ...): evidence on targets that were met exactly, and paired with the baseline."""
    usable, known = F.col("predicted").isNotNull(), F.col("actual").isNotNull()
    key = W.partitionBy("series", "origin_at", "horizon")
    base = F.max(F.when((F.col("model") == baseline) & usable & known, F.col("abs_pct"))).over(key)
    rows = frozen.withColumn("__base", base)
    exact = usable & known
    both = exact & F.col("__base").isNotNull()
    return rows.groupBy("model", *by).agg(
        F.count("*").alias("attempts"), F.count_if(~usable).alias("failures"), F.count_if(exact).alias("exact"), F.count_if(both).alias("paired"),
        F.avg(F.when(both, F.col("abs_pct"))).alias("mae"), F.avg(F.when(both, F.col("__base"))).alias("baseline_mae"), F.count_if(both & (F.col("abs_pct") < F.col("__base"))).alias("wins"),
    )


ENTRY = ("at", "action", "key", "status", "before", "after", "entry_id")


def entries(changes: DataFrame, at: Column, action: str = "recalibrate") -> DataFrame:
    """Log entries of changes (key, status, before, after), each with an id of its content, so that the same change is the same entry."""
    out = changes.select(at.alias("at"), F.lit(action).alias("action"), F.col("key").cast("string").alias("key"), "status", F.col("before").cast("double").alias("before"), F.col("after").cast("double").alias("after"))
    said = F.concat_ws("|", F.unix_timestamp(F.col("at").cast("timestamp")).cast("string"), "action", "key", "status", *[F.coalesce(F.round(F.col(c) * 1_000_000).cast("long").cast("string"), F.lit("")) for c in ("before", "after")])
    return out.withColumn("entry_id", F.sha2(said.cast("binary"), 256))


def appended(new: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The entries of new that the log doesn't have yet; running twice appends once."""
    return first_writes(new, stored, ["entry_id"], [F.col("at")])


def rollback(current: DataFrame, log: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(current with the values before the last applied change that is not rolled back, entries of the rollback to append).

    current: key, multiplier. A rollback without such a change is an error, raised
    when its entries or the result are read.
    """
    done = log.where("action = 'rollback'").select(F.col("key").alias("__key"), F.col("after").alias("__back"), F.col("at").alias("__at"))
    applied = log.where("action = 'recalibrate' AND status = 'applied'")
    undone = applied.join(done, (F.col("key") == F.col("__key")) & (F.col("before") == F.col("__back")) & (F.col("at") < F.col("__at")), "left_anti")
    newest = undone.agg(F.max("at").alias("at"))
    last = undone.join(F.broadcast(newest), "at").select("key", F.col("before").alias("back"))  # one row is broadcast
    some = newest.select(F.when(F.col("at").isNull(), F.raise_error(F.lit("no applied change to roll back"))).otherwise(F.lit(True)).alias("__ok"))
    out = current.crossJoin(F.broadcast(some)).where("__ok").drop("__ok").join(last, "key", "left")  # one row is broadcast
    moved = out.where("back IS NOT NULL").select("key", F.lit("rolled_back").alias("status"), F.col("multiplier").alias("before"), F.col("back").alias("after"))
    return out.select("key", F.coalesce("back", "multiplier").alias("multiplier")), entries(moved, at, "rollback")


STAGES = ("raw_cumulative", "pre_coherence", "final")


def interval_gate(predictions: DataFrame, outcomes: DataFrame, audit: DataFrame, horizons: Sequence[int], least_pairs: int = 200, days: int = 30) -> DataFrame:
    """(reason, horizon, rows): every reason for which intervals may not be judged yet; none if they may.

    predictions: origin_at, horizon, target_at, stage, source_identity and
    candidate_identity, a row for each stage of a forecast. outcomes: origin_at,
    horizon, target_at, actual, actual_at and matured_at. audit, of one row:
    status, manifest_sha256, exact_target_coverage, prospective_period_ready,
    pipeline_ready, frozen_at, prospective_start and evaluated_at; what is absent
    or null blocks. rows counts what breaks the rule, or is there of what it asks.
    """
    spark = predictions.sparkSession
    yes = lambda c: F.coalesce(c, F.lit(False))
    length = F.make_dt_interval(F.lit(days))
    facts = spark.range(1).drop("id").join(audit, F.lit(True), "left")
    ready = yes((F.col("status") == "ready") & F.col("manifest_sha256").rlike("^[0-9a-f]{64}$") & F.col("exact_target_coverage") & F.col("prospective_period_ready"))
    timed = yes((F.col("prospective_start") >= F.col("frozen_at")) & (F.col("evaluated_at") >= F.col("prospective_start") + length))
    said = F.array(F.when(~ready, F.lit("audit_not_ready")), F.when(~timed, F.lit("temporal_manifest")), F.when(~yes(F.col("pipeline_ready")), F.lit("pipeline_not_ready")))
    of_audit = facts.select(F.explode(F.array_compact(said)).alias("reason"), F.lit(None).cast("int").alias("horizon"), F.lit(1).cast("long").alias("rows"))
    times = facts.select(*[F.when(timed, F.col(c)).alias(c) for c in ("frozen_at", "prospective_start", "evaluated_at")])

    key = ["origin_at", "horizon", "target_at"]
    exact = yes((F.col("horizon") > 0) & (F.col("target_at") == F.col("origin_at") + F.make_dt_interval(F.lit(0), F.col("horizon"))))
    sound = exact & yes(F.col("stage").isin(*STAGES)) & yes((F.col("source_identity") != "") & (F.col("candidate_identity") != ""))
    ids = F.struct("source_identity", "candidate_identity")
    linked = predictions.withColumn("sound", sound).groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct("stage").alias("stages"), F.countDistinct(ids).alias("ids"), F.min(F.col("sound").cast("int")).alias("sound"))
    linked = linked.withColumn("complete", (F.col("n") == len(STAGES)) & (F.col("stages") == len(STAGES)) & (F.col("ids") == 1) & (F.col("sound") == 1))
    met = outcomes.crossJoin(F.broadcast(times))  # one row is broadcast
    right = exact & yes(F.col("actual").isNotNull() & (F.col("actual_at") == F.col("target_at")) & (F.col("matured_at") >= F.col("target_at")) & (F.col("evaluated_at") > F.col("target_at")) & (F.col("evaluated_at") > F.col("matured_at")))
    met = met.withColumn("right", right).groupBy(*key).agg(F.count("*").alias("times"), F.min(F.col("right").cast("int")).alias("right"), *[F.first(c).alias(c) for c in ("frozen_at", "prospective_start", "evaluated_at")])
    both = met.join(linked.where("complete").select(*key, F.lit(1).alias("has")), key, "left")
    both = both.withColumn("paired", (F.col("times") == 1) & (F.col("right") == 1) & F.col("has").isNotNull())
    before = yes(F.col("origin_at") < F.col("frozen_at"))
    ahead = yes((F.col("origin_at") >= F.col("prospective_start")) & (F.col("origin_at") < F.col("evaluated_at")))
    both = both.withColumn("period", F.when(before, "evaluation").when(ahead, "prospective"))
    whole = lambda df, reason, wrong, some: df.agg(F.count_if(wrong).alias("rows"), F.count_if(some).alias("__some")).where("rows > 0 OR __some = 0").select(F.lit(reason).alias("reason"), F.lit(None).cast("int").alias("horizon"), "rows")
    paired = both.where("paired")
    lineage = whole(linked, "incomplete_lineage", ~F.col("complete"), F.col("complete"))
    pairing = whole(both, "unpaired_outcomes", ~F.col("paired"), F.col("paired"))
    outside = paired.where("period IS NULL").groupBy().agg(F.count("*").alias("rows")).where("rows > 0").select(F.lit("outside_periods").alias("reason"), F.lit(None).cast("int").alias("horizon"), "rows")
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(int(h)) for h in horizons])).alias("horizon"))
    when = lambda p, c: F.when(F.col("period") == p, c)
    per = paired.groupBy("horizon").agg(
        F.count(when("evaluation", F.lit(1))).alias("old"), F.count(when("prospective", F.lit(1))).alias("new"), F.min(when("prospective", F.col("origin_at"))).alias("low"), F.max(when("prospective", F.col("origin_at"))).alias("high"), F.first("prospective_start").alias("start"),
    )
    per = asked.join(per, "horizon", "left").fillna(0, ["old", "new"])
    hour = F.expr("INTERVAL 1 HOUR")
    spans = yes((F.col("low") <= F.col("start") + hour) & (F.col("low") >= F.col("start") - hour) & (F.col("high") - F.col("low") >= length))
    short = per.where(~spans).select(F.lit("short_prospective_span").alias("reason"), "horizon", F.col("new").alias("rows"))
    few = per.where(F.least("old", "new") < least_pairs).select(F.lit("too_few_pairs").alias("reason"), "horizon", F.least("old", "new").alias("rows"))
    out = of_audit
    for part in (lineage, pairing, outside, short, few):
        out = out.unionByName(part)
    return out
