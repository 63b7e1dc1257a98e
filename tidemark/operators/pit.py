"""Point-in-time joins: as-of in both directions, nearest, ranges, and what had matured.

As-of joins are a union and one window per key: a single shuffle on the key,
no product of the sides, and no more memory than the window's frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: Column, forward: bool = False, strict: bool = False) -> DataFrame:
    """left with `found`, a struct of the right row's time and value that is last at or before its own time.

    forward: the first at or after instead. strict: equal times don't count.
    """
    own = left.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(1).alias("__left"), F.struct(*left.columns).alias("__row"), F.lit(None).alias("__found"))
    other = right.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(0).alias("__left"), F.lit(None).alias("__row"), F.struct(F.col(at).alias("at"), value.alias("value")).alias("__found"))
    turn = -1 if strict else 1
    side = (F.col("__left") * turn).asc()
    time = F.col("__at").desc() if forward else F.col("__at").asc()
    frame = W.partitionBy("__key").orderBy(time, side).rowsBetween(W.unboundedPreceding, 0)
    both = own.unionByName(other).withColumn("found", F.last("__found", ignorenulls=True).over(frame))
    return both.where("__left = 1").select("__row.*", "found")


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, value: Column, within: Column | None = None) -> DataFrame:
    """left with `found` as in as_of(), the nearest in either direction; ties go to the earlier one."""
    back = as_of(left, right, key, at, value).withColumnRenamed("found", "__back")
    both = as_of(back, right, key, at, value, forward=True)
    away = lambda c: F.abs(F.unix_micros(F.col(f"{c}.at").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp")))
    near = F.when(F.col("found").isNull() | (away("__back") <= away("found")), F.col("__back")).otherwise(F.col("found"))
    out = both.withColumn("found", near).drop("__back")
    return out if within is None else out.withColumn("found", F.when(away("found") <= within, F.col("found")))


def matured(rows: DataFrame, now: Column) -> DataFrame:
    """Rows whose outcome is known and whose target lies at or before now."""
    return rows.where(F.col("actual").isNotNull() & (F.col("target_at") <= now))


def visible(value: Column, known_at: Column, cutoff: Column) -> Column:
    """A value, as far as it was known at the cutoff."""
    return F.when(known_at <= cutoff, value)


def eligible_counts(rows: DataFrame, horizon: Column) -> DataFrame:
    """rows (series, ts) with eligible: how many origins of the series had matured by then, without a range join.

    A row matures a horizon after its origin; counting those at or before each
    origin is a running sum over the union of origins and maturities.
    """
    own = rows.select("series", "ts", F.lit(0).alias("came"), F.lit(1).alias("own"))
    done = rows.select("series", (F.col("ts") + F.make_dt_interval(F.lit(0), horizon)).alias("ts"), F.lit(1).alias("came"), F.lit(0).alias("own"))
    frame = W.partitionBy("series").orderBy("ts").rangeBetween(W.unboundedPreceding, 0)
    return own.union(done).withColumn("eligible", F.sum("came").over(frame)).where("own = 1").select("series", "ts", "eligible")


def range_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, bucket_seconds: int) -> DataFrame:
    """Points with every span that they lie in, start included and end not, by an equi-join on time buckets."""
    number = lambda c: F.floor(F.unix_timestamp(c.cast("timestamp")) / bucket_seconds)
    last = F.greatest(number(F.col(end) - F.expr("INTERVAL 1 MICROSECOND")), number(F.col(start)))
    dealt = spans.withColumn("__bucket", F.explode(F.sequence(number(F.col(start)), last)))
    return points.withColumn("__bucket", number(F.col(at))).join(dealt, "__bucket").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bucket")


def range_sums(points: DataFrame, spans: DataFrame, key: str, at: str, value: str, start: str, end: str, bucket_seconds: int) -> DataFrame:
    """key of each span with points in it, with events and the sum of their value, without pairing spans and points.

    A span is what came before its end less what came before its start: running
    sums within a time bucket, and the totals of the buckets from start to end.
    """
    number = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / bucket_seconds)
    came = points.select(number(at).alias("__bucket"), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).alias("__key"), F.lit(0).alias("__sign"), F.lit(1).alias("__n"), F.col(value).alias("__v"))
    edge = lambda c, sign: spans.select(number(c).alias("__bucket"), F.col(c).alias("__at"), F.lit(0).alias("__side"), F.col(key).alias("__key"), F.lit(sign).alias("__sign"), F.lit(0).alias("__n"), F.lit(None).alias("__v"))
    frame = W.partitionBy("__bucket").orderBy("__at", "__side").rowsBetween(W.unboundedPreceding, 0)
    sums = lambda over: [F.coalesce(x if over is None else x.over(over), F.lit(0)) for x in (F.sum("__n"), F.count("__v"), F.sum("__v"))]
    n, k, v = sums(frame)
    edges = came.unionByName(edge(start, -1)).unionByName(edge(end, 1)).select("__side", "__key", "__sign", n.alias("n"), k.alias("k"), v.alias("v")).where("__side = 0")
    edges = edges.select("__key", *[(F.col("__sign") * F.col(c)).alias(c) for c in "nkv"])
    n, k, v = sums(None)
    totals = came.groupBy("__bucket").agg(n.alias("n"), k.alias("k"), v.alias("v"))
    passed = spans.where(number(start) < number(end)).select(F.col(key).alias("__key"), F.explode(F.sequence(number(start), number(end) - 1)).alias("__bucket"))
    parts = edges.unionByName(passed.join(totals, "__bucket").select("__key", "n", "k", "v"))
    out = parts.groupBy(F.col("__key").alias(key)).agg(F.sum("n").alias("events"), F.sum("k").alias("__k"), F.sum("v").alias("__v")).where("events > 0")
    return out.select(key, "events", F.when(F.col("__k") > 0, F.col("__v")).alias("value"))
