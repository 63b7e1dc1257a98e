import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import inference, monitoring, specialists, store


def hour(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)


def test_degraded_and_first_positive(spark):
    origins = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    source = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 9.0), ("c", None, 1.0)], "k string, v double, age double")
    out = monitoring.degraded(origins, source, ["k"], ["v"], F.col("age"), 2).collect()
    assert sorted((r["k"], r["quality"], r["v"]) for r in out) == [("a", "ok", 1.0), ("b", "stale", None), ("c", "partial", None), ("d", "unavailable", None)]
    row = spark.createDataFrame([(float("nan"), -1.0, math.inf, 2.0)], "a double, b double, c double, d double")
    assert row.select(monitoring.first_positive(*[F.col(c) for c in "abcd"]).alias("x")).first()["x"] == 2.0


def test_alerts_and_assertions(spark):
    report = spark.createDataFrame([("s", 5, 0), ("t", 1, 0)], "series string, gaps long, fills long")
    out = monitoring.threshold_alerts(report, {"gaps": (2, 5), "fills": (0, 9)}, "series").collect()
    assert [(r["series"], r["level"], r["threshold"]) for r in out] == [("s", "critical", 5)]
    rows = spark.createDataFrame([(hour(2), hour(1)), (hour(2), hour(3)), (hour(2), None)], "o timestamp_ntz, c timestamp_ntz")
    assert monitoring.lookahead_violations(rows, "o", ["c"]).count() == 2
    same = spark.createDataFrame([(1,), (1,)], "o int")
    assert monitoring.origins_apart(same, same, ["o"]).count() == 0
    assert monitoring.origins_apart(same, same.distinct(), ["o"]).collect()[0]["side"] == "one"


def test_capped_shares(spark):
    rows = [("g", "a", 8.0), ("g", "b", 1.0), ("g", "c", 1.0), ("g", "d", 0.0), ("h", "a", 1.0)]
    out = {(r["g"], r["model"]): r["share"] for r in specialists.capped_shares(spark.createDataFrame(rows, "g string, model string, w double"), "w", 0.5, "g").collect()}
    assert out[("g", "a")] == pytest.approx(0.5) and out[("g", "b")] == pytest.approx(0.25) and out[("g", "d")] == 0 and out[("h", "a")] is None


def test_targets_and_paths(spark):
    row = spark.createDataFrame([(110.0, 100.0)], "p double, o double")
    back = [row.select(specialists.from_target(specialists.to_target(F.col("p"), F.col("o"), t), F.col("o"), t).alias("x")).first()["x"] for t in specialists.TARGETS]
    assert back == pytest.approx([110.0] * 3)
    paths = spark.createDataFrame([(100.0, [0.0, -0.1], [0.0, 0.0], [0.1, 0.1]), (100.0, [0.2], [0.0], [0.1])], "o double, q10 array<double>, q50 array<double>, q90 array<double>")
    out = specialists.quantile_paths(paths, "o", ("q10", "q50", "q90")).collect()
    assert [r["crossing"] for r in out] == [False, True] and out[0]["path_q10"][1] == pytest.approx(100 * math.exp(-0.1))


def test_recalibration_is_bounded(spark):
    rows = [(50, 0.6, 50, 0.6, 1.0, 1.3), (50, 0.6, 50, 0.3, 1.0, 2.0), (5, 0.1, 5, 0.1, 1.0, 1.2), (50, 0.81, 50, 0.6, 1.0, 1.2)]
    out = specialists.recalibration(spark.createDataFrame(rows, "samples int, coverage double, hits int, hit_rate double, before double, recommended double")).collect()
    assert [r["status"] for r in out] == ["applied", "unsafe_change", "kept", "kept"] and out[0]["after"] == pytest.approx(1.1) and out[1]["alerts"] == ["direction_drift", "unsafe_change"]


def test_inference(spark):
    pairs = spark.createDataFrame([("m", hour(k), 1.0 + (k % 2)) for k in range(40)], "model string, origin_at timestamp_ntz, gain double")
    out = inference.long_run_z(pairs, "gain", 2, "origin_at", "model").first()
    assert out["pairs"] == 40 and out["mean_gain"] == pytest.approx(1.5) and out["z"] == pytest.approx(1.5 / math.sqrt(0.25 / 40))
    rows = spark.createDataFrame([(k, "x" if k % 2 else "y", float(k % 2)) for k in range(100)], "id long, g string, v double")
    out = inference.unpaired_bootstrap(rows, "v", "g", "id", "x", "y", 50, 20, False).first()
    assert out["difference"] == pytest.approx(1.0) and out["conclusion"] == "better"


def test_unknown_features_raise(spark):
    registry = spark.createDataFrame([("a", 1, "s")], "name string, version int, source string")
    assert store.resolved_features(registry, ["a"]).first()["features"] == 1
    with pytest.raises(Exception, match="unknown feature"):
        store.resolved_features(registry, ["a", "z"]).collect()


def bars_of(spark, spec):
    """series to candles: hours from the start, with a close and a volume."""
    rows = [(s, hour(k), c, c, c, c, v) for s, points in spec.items() for k, c, v in points]
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def test_every_branch_of_provider_selection(spark):
    good, holed, far = [(k, 10.0, 5.0) for k in range(40)], [(k, 10.0, 5.0) for k in range(40) if k != 7], [(k, 90.0, 5.0) for k in range(40)]
    bad = [(k, 10.0 if k else -1.0, 5.0) for k in range(40)]
    primary = {"well": good, "differ": good, "unwell_differ": good, "cut": holed, "apart": [(k - 100, c, v) for k, c, v in holed], "bad": holed}
    secondary = {"well": good, "differ": far, "unwell_differ": [(k, c, v) for k, c, v in far if k != 9], "cut": good, "apart": good, "bad": [x for x in bad if x[0] != 9], "gone": good, "gone_bad": bad}
    now = F.lit(hour(40))
    out = monitoring.selected_source(bars_of(spark, primary), bars_of(spark, secondary), ["missing_interval", "non_positive_price"], now).collect()
    assert {r["series"]: (r["reason"], r["source"]) for r in out} == {
        "well": ("primary_healthy", "primary"), "differ": ("providers_disagree", None), "unwell_differ": ("providers_disagree", None), "cut": ("failover", "secondary"),
        "apart": ("failover_without_agreement", None), "bad": ("none_healthy", None), "gone": ("primary_outage", "secondary"), "gone_bad": ("none_healthy", None),
    }


def test_withheld_forecasts_raise_an_alert(spark):
    report = spark.createDataFrame([("a", 0, 2, "withhold"), ("b", 0, 5, "withhold"), ("c", 0, 0, "withhold"), ("d", 9, 0, "none"), ("e", 0, 0, None)], "series string, gaps long, withhold_gaps long, policy string")
    alerts = monitoring.threshold_alerts(report, {"gaps": (0, 9), "withhold_gaps": (0, 3)}, "series", F.col("policy") == "withhold")
    assert sorted(tuple(r) for r in alerts.collect()) == [
        ("a", "forecast_withheld", 2, "critical", 3), ("b", "withhold_gaps", 5, "critical", 3), ("c", "forecast_withheld", 1, "critical", 3), ("d", "gaps", 9, "critical", 9)
    ]
    assert {r["series"]: (r["level"], r["alerts"]) for r in monitoring.overall_level(alerts, "series", report).collect()} == {"a": ("critical", 1), "b": ("critical", 1), "c": ("critical", 1), "d": ("critical", 1), "e": ("ok", 0)}


def test_every_code_of_the_validator(spark):
    from tidemark.operators.candles import QualityLimits, quality_report

    fine = [(k, 10.0, 5.0) for k in range(70)]
    spec = {
        "fine": fine, "short": fine[-9:], "jump": [(k, 10.0 if k < 30 else 20.0, v) for k, _, v in fine], "loud": [(k, c, 5.0 if k != 50 else 900.0) for k, c, _ in fine], "still": [(k, c, 5.0 if k != 50 else 0.0) for k, c, _ in fine],
        "twice": [*fine, fine[3]], "hole": [x for x in fine if x[0] != 9], "old": [(k - 9, c, v) for k, c, v in fine], "ahead": [(k + 9, c, v) for k, c, v in fine], "sunk": [(k, -1.0 if k == 5 else c, v) for k, c, v in fine], "nan": [(k, float("nan") if k == 5 else c, v) for k, c, v in fine],
    }
    bars = bars_of(spark, spec).unionByName(bars_of(spark, {"bent": fine}).withColumns({"high": F.when(F.hour("ts") == 3, 9.0).otherwise(F.col("high")), "low": F.when(F.hour("ts") == 5, 5.0).otherwise(F.col("low"))}))
    got = {}
    for r in quality_report(bars, F.lit(hour(70)), QualityLimits()).collect():
        got.setdefault(r["series"], {})[r["code"]] = r["rows"]
    prices = lambda kind: {f"{kind}_{c}": 1 for c in ("open", "high", "low", "close")}
    assert got == {
        "short": {"insufficient_candles": 1}, "jump": {"extreme_hourly_return": 1}, "loud": {"extreme_volume": 1}, "still": {"non_positive_volume": 1}, "twice": {"duplicate_timestamp": 1}, "hole": {"missing_or_irregular_candle": 1},
        "old": {"stale_data": 1}, "ahead": {"future_timestamp": 1}, "sunk": prices("non_positive"), "nan": prices("non_finite"), "bent": {"invalid_ohlc": 3, "extreme_candle_range": 3},
    }
    late = bars_of(spark, {"late": fine}).withColumn("came", F.col("ts") + F.when(F.col("ts") == F.lit(hour(5)), F.expr("INTERVAL 4 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS")))
    assert {r["code"]: r["rows"] for r in quality_report(late, F.lit(hour(70)), QualityLimits(), "came").collect()} == {"out_of_order_timestamp": 1, "missing_or_irregular_candle": 2}
    early = spark.createDataFrame([("x", dt.datetime(1970, 1, 1))], "series string, ts timestamp_ntz").withColumns({c: F.lit(1.0) for c in ("open", "high", "low", "close", "volume")})
    assert {r["code"] for r in quality_report(early, F.lit(hour(0))).collect()} == {"invalid_timestamp", "insufficient_candles", "stale_data"}
