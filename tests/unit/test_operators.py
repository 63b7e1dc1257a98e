"""Operators that SQL can't say, against plain Python; and what must not change with the future."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import candles, drift, evaluate, features, forecasts, inference, pit, store

T0 = dt.datetime(2024, 1, 1)


def hour(k):
    return T0 + dt.timedelta(hours=k)


def series(spark, closes, volumes=None, name="s", skip=()):
    rows = [(name, hour(k), c, c + 0.5, c - 0.5, c, int(v)) for k, (c, v) in enumerate(zip(closes, volumes or [10] * len(closes))) if k not in skip]
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, open double, high double, low double, close double, volume long")


@pytest.fixture(scope="module")
def walk():
    return (np.exp(np.cumsum(np.random.default_rng(1).normal(0, 0.02, 260))) * 100).tolist()


def test_features_ignore_the_future(spark, walk):
    whole = features.market_features(series(spark, walk)).where(F.col("ts") < hour(200))
    part = features.market_features(series(spark, walk[:200]))
    assert sorted(map(str, whole.collect())) == sorted(map(str, part.collect()))


def test_forecasts_ignore_the_future(spark, walk):
    whole = forecasts.baselines(series(spark, walk)).where(F.col("origin_at") < hour(200))
    assert sorted(map(str, whole.collect())) == sorted(map(str, forecasts.baselines(series(spark, walk[:200])).collect()))


def test_ema_and_ar1(spark, walk):
    ret = np.diff(np.log(walk))
    ema = {r["ts"]: r["ema"] for r in forecasts.ema_forecast(series(spark, walk)).collect()}
    for k in (1, 5, 200, 259):
        part = ret[max(0, k - 168) : k] if k < 168 else ret[k - 168 : k]
        want = part[0]
        for r in part[1:]:
            want = want * (1 - 2 / 25) + r * 2 / 25
        assert ema[hour(k)] == pytest.approx(want)
    paths = {r["ts"]: r for r in forecasts.ar1_paths(series(spark, walk)).collect()}
    k = 259
    x, y = ret[k - 169 : k - 1], ret[k - 168 : k]
    phi = max(-0.95, min(0.95, np.cov(y, x, ddof=0)[0, 1] / x.var()))
    last, want = y[-1], []
    for _ in range(16):
        last = max(-4 * y.std(), min(4 * y.std(), y.mean() + phi * (last - y.mean())))
        want.append(last)
    assert paths[hour(k)]["phi"] == pytest.approx(phi) and paths[hour(k)]["path"] == pytest.approx(want)


def test_winsorising_sees_capped_values(spark):
    volumes = [10] * 30 + [500, 500, 500] + [10] * 5
    out = candles.winsorise_volume(series(spark, [1.0 + k for k in range(38)], volumes), 6, 3).orderBy("ts").collect()
    want = [float(v) for v in volumes]
    for k in range(1, 38):
        m = float(np.median(want[max(0, k - 6) : k]))
        want[k] = min(want[k], 3 * m) if m > 0 else want[k]
    assert [r["capped_volume"] for r in out] == want


def test_backfill_twice_is_once(spark):
    primary, secondary = series(spark, [100.0] * 60, skip=(10, 30, 31, 50, 51, 52, 53)), series(spark, [100.1] * 60)
    once = candles.backfill(primary, secondary)
    assert once.where("provenance = 'secondary'").count() == 3
    assert candles.backfill(once.drop("provenance"), secondary).where("provenance = 'secondary'").count() == 0
    far = candles.gap_decisions(primary, series(spark, [120.0] * 60)).collect()
    assert {r["action"] for r in far} == {"degrade", "withhold"}


def test_confirmed_labels(spark):
    labels = "AABABBBAAB"
    df = spark.createDataFrame([("s", hour(k), c) for k, c in enumerate(labels)], "series string, ts timestamp_ntz, label string")
    assert "".join(r["confirmed"] for r in features.confirmed_labels(df).orderBy("ts").collect()) == "AAAAABBBAA"


def test_bounded_normalize(spark):
    for raw in ([1.0, 2.0, 3.0, 4.0], [100.0, 1.0, 1.0, 1.0], [1e-9, 1.0, 1.0], [1.0]):
        got = spark.range(1).select(scalars.bounded_normalize(F.array(*map(F.lit, raw))).alias("w")).first()["w"]
        if len(raw) * 0.55 < 1:
            assert got == [1.0]
            continue
        lo, hi = 0.0, 1e12
        for _ in range(300):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(0.55, max(0.03, w * mid)) for w in raw) < 1 else (lo, mid)
        assert sum(got) == pytest.approx(1) and got == pytest.approx([min(0.55, max(0.03, w * hi)) for w in raw], abs=1e-9)


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.pinball(F.lit(5.0), F.lit(4.0), 0.9).alias("a"), scalars.legacy_pinball(F.lit(5.0), F.lit(4.0), 0.9).alias("b"), scalars.winkler(F.lit(9.0), F.lit(4.0), F.lit(8.0), 0.2).alias("c"),
        scalars.within(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0)).alias("d"), scalars.direction(F.lit(0.004)).alias("e"), scalars.harmonic(F.lit(4)).alias("f"),
        scalars.adjusted_p("by", F.lit(0.01), F.lit(4), F.lit(2)).alias("g"),
    ).first()
    assert row["a"] == pytest.approx(0.9) and row["b"] == pytest.approx(-0.9) and row["c"] == pytest.approx(14) and row["d"] is None and row["e"] == 0
    assert row["f"] == pytest.approx(1 + 1 / 2 + 1 / 3 + 1 / 4) and row["g"] == pytest.approx(0.01 * 4 * (25 / 12) / 2)


def test_as_of_ties(spark):
    left = spark.createDataFrame([("k", hour(1)), ("k", hour(3)), ("j", hour(3))], "key string, at timestamp_ntz")
    right = spark.createDataFrame([("k", hour(1), 1), ("k", hour(3), 3)], "key string, at timestamp_ntz, v int")
    value = lambda **kw: [None if r["found"] is None else r["found"]["value"] for r in pit.as_of(left, right, "key", "at", F.col("v"), **kw).orderBy("key", "at").collect()]
    assert value() == [None, 1, 3] and value(strict=True) == [None, None, 1]
    assert value(forward=True) == [None, 1, 3] and value(forward=True, strict=True) == [None, 3, None]


def test_folds_never_leak(spark):
    out = evaluate.folds(series(spark, [1.0] * 200).select("series", "ts"), 4, 10, 6, 20).collect()
    for fold in {r["fold"] for r in out}:
        train = [r["ts"] for r in out if r["fold"] == fold and r["role"] == "train"]
        valid = [r["ts"] for r in out if r["fold"] == fold and r["role"] == "validate"]
        assert max(train) + dt.timedelta(hours=16) <= min(valid) and len(train) >= 20
    assert len({r["ts"] for r in out if r["role"] == "validate"}) == 160


def test_bootstrap(spark):
    rng = np.random.default_rng(2)
    rows = [(g, k, float(1 + rng.normal()), float(1 + shift + rng.normal())) for g, shift in (("better", 1.0), ("same", 0.0)) for k in range(150)] + [("few", 0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, k long, c double, b double")
    run = lambda d: {r["g"]: r for r in inference.paired_bootstrap(d, "c", "b", "k", ["g"]).collect()}
    one, two = run(df), run(df.repartition(3))
    assert one == two and one["better"]["p_better"] > 0.99 and one["better"]["low"] > 0 and one["few"]["low"] is None
    assert one["same"]["low"] < one["same"]["mean"] < one["same"]["high"]


def test_family(spark):
    p = [0.001, 0.012, 0.02, 0.2, 0.5]
    df = spark.createDataFrame([("f", x) for x in p], "g string, p double")
    rejected = lambda m: [r["rejected"] for r in inference.family(df, m, 0.05, ["g"]).orderBy("p").collect()]
    assert rejected("holm") == [True, True, False, False, False] and rejected("bonferroni") == [True, False, False, False, False]
    assert rejected("by") == [x <= (max([k + 1 for k, y in enumerate(p) if y <= 0.05 * (k + 1) / (5 * sum(1 / i for i in range(1, 6)))], default=0) and p[max([k for k, y in enumerate(p) if y <= 0.05 * (k + 1) / (5 * sum(1 / i for i in range(1, 6)))])]) for x in p]


def test_store(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 4.0), ("b", 2, 1.0)], "k string, seen int, v double")
    first = store.first_writes(rows, None, ["k"], [F.col("seen"), F.col("v")])
    assert sorted((r["k"], r["v"]) for r in first.collect()) == [("a", 4.0), ("b", 1.0)]
    assert store.first_writes(rows, first, ["k"], [F.col("seen")]).count() == 0
    assets = spark.createDataFrame([("g", k, s) for k, s in enumerate([5, 30, 20, 90, 10])], "g string, at int, size long")
    assert sorted(r["at"] for r in store.retention(assets, "size", "at", 3, 60, "g").where("keep").collect()) == [1, 2, 4]
    signals = spark.createDataFrame([("g", hour(k), hour(k + 4)) for k in (0, 1, 4, 6, 8)], "g string, origin_at timestamp_ntz, target_at timestamp_ntz")
    assert sorted(r["origin_at"] for r in store.non_overlapping(signals, "g").collect()) == [hour(0), hour(4), hour(8)]


def test_nesting_round_trip(spark, walk):
    rows = forecasts.baselines(series(spark, walk)).select("series", "origin_at", "model", "horizon", "predicted", "q10", "q90").where("predicted IS NOT NULL")
    assert sorted(map(str, store.flattened(store.nested(rows)).select(*rows.columns).collect())) == sorted(map(str, rows.collect()))


def test_learners_see_only_matured_rows(spark):
    rng = np.random.default_rng(3)
    rows = [("s", hour(k), [float(a), float(b)], float(2 * a - b)) for k, (a, b) in enumerate(rng.normal(0, 1, (300, 2)))]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, x array<double>, y double")
    later = df.withColumn("y", F.when(F.col("ts") >= hour(250), F.col("y") + 100).otherwise(F.col("y")))
    for method in ("ridge", "elastic"):
        one, two = ({r["ts"]: r["prediction"] for r in forecasts.walk_forward_linear(d, 8, method, 100).collect()} for d in (df, later))
        assert all(one[t] == two[t] for t in one if t <= hour(250)) and np.mean([abs(one[r[1]] - r[3]) for r in rows if r[1] in one]) < 0.5
    trees = forecasts.boosted_trees(df).collect()
    assert len(trees) == 150 and np.corrcoef([r["prediction"] for r in trees], [r["y"] for r in trees])[0, 1] > 0.8


def test_drift(spark):
    rows = [("m", hour(k), 1.0 + 0.01 * k, 1.0, 1) for k in range(24)] + [("m", hour(24 + k), 5.0 + k, 1.0, 0) for k in range(8)]
    rows += [("few", hour(k), 1.0, 1.0, 1) for k in range(31)] + [("m", hour(99), None, 1.0, 1)]
    df = spark.createDataFrame(rows, "model string, target_at timestamp_ntz, abs_pct double, signed_pct double, direction_correct int")
    (out,) = drift.error_drift(df, 8, 24, drift.Thresholds(), "model").collect()
    before = [1.0 + 0.01 * k for k in range(24)]
    middle = float(np.median(before))
    scale = max(1.4826 * float(np.median(np.abs(np.array(before) - middle))), 0.1 * middle)
    assert out["severity"] == "severe" and out["abs_ks"] == pytest.approx(1) and out["direction_drop"] == 1
    assert out["abs_shift"] == pytest.approx((8.5 - middle) / scale, abs=1e-5) and out["signed_shift"] == 0 and out["signed_ks"] == 0


def test_drift_events_are_stored_once(spark):
    signals = [(hour(0), "a", "severe"), (hour(0), "a", "severe"), (hour(0), "b", "none"), (hour(1), "a", "severe"), (hour(0), "a", "warning")]
    df = spark.createDataFrame(signals, "origin_at timestamp_ntz, signal_key string, severity string")
    first = drift.drift_events(df, None)
    assert sorted((r["origin_at"], r["severity"]) for r in first.collect()) == [(hour(0), "severe"), (hour(0), "warning"), (hour(1), "severe")]
    assert drift.drift_events(df, first).count() == 0
