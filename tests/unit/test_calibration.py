"""Conditional calibration against a loop over groups and buckets, and what may not change it."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration, evaluate, ledger

START = dt.datetime(2024, 3, 1)
NOW = START + dt.timedelta(hours=400)
COLUMNS = "model string, bucket string, origin_at timestamp_ntz, target_at timestamp_ntz, predicted double, q10 double, q90 double, actual double"
POLICY = calibration.Policy(limit=60)


def history(seed=1):
    """Three models: one with plenty of every bucket, one with few rows, one whose rows are all unusable."""
    draw = random.Random(seed)
    out = []
    for k in range(420):
        at = START + dt.timedelta(hours=k)
        bucket = draw.choice(["range:low"] * 8 + ["range:high"] * 3 + ["trending:low"])
        wide = 3.0 if bucket == "range:high" else 1.0
        out.append(("a", bucket, at, at + dt.timedelta(hours=4), 100.0, 99.0, 101.0, 100 + draw.gauss(0, wide)))
        if k % 30 == 0:
            out.append(("b", bucket, at, at + dt.timedelta(hours=4), 100.0, 98.0, 102.0, 100 + draw.gauss(0, 2)))
    at = START
    bad = [(100.0, 101.0, 99.0, 100.0), (100.0, 99.0, 101.0, None), (-1.0, 99.0, 101.0, 100.0), (None, 99.0, 101.0, 100.0), (100.0, None, 101.0, 100.0), (math.nan, 99.0, 101.0, 100.0)]
    return out + [("c", "unknown:unknown", at + dt.timedelta(hours=k), at + dt.timedelta(hours=k + 4), *row) for k, row in enumerate(bad)]


def higher(scores, target):
    scores, n = sorted(scores), len(scores)
    return min(3.0, max(0.5, scores[math.ceil(min(1.0, math.ceil((n + 1) * target) / n) * (n - 1))]))


def looped(rows, now, p):
    """(model, bucket) to the figures of every bucket, and model to its samples and buckets."""
    found, groups = {}, {}
    for model in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == model), key=lambda r: r[2])
        good = [(r[1], abs(r[7] - r[4]) / ((r[6] - r[5]) / 2)) for r in mine if r[3] <= now and None not in r[4:] and r[4] > 0 and r[6] > r[5]]
        whole = good[-p.limit :]
        n = len(whole)
        covered = sum(s <= 1 for _, s in whole) / n if n else None
        marginal = higher([s for _, s in whole], p.target) if n >= p.least else min(1.75, max(0.75, math.sqrt(p.target / max(covered, 0.1)))) if n >= 10 else 1.0
        for bucket in {r[1] for r in mine}:
            scores = [s for b, s in good if b == bucket][-p.limit :]
            k = len(scores)
            own = higher(scores, p.target) if k else None
            m = own if k >= p.least else (k / p.least * own + (1 - k / p.least) * marginal if k else marginal)
            after = sum(s <= m for s in scores) / k if k else None
            found[model, bucket] = (k, m, marginal, after, after is not None and abs(after - p.target) <= p.tolerance + 1e-9)
        inside = [s <= round(found[model, b][1], 4) for b, s in whole]
        groups[model] = sum(inside) / n if n else None
    return found, groups


def near(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 1e-9)


def frames(spark, rows, buckets):
    current = spark.createDataFrame([(m, b, 100.0, 98.0, 102.0) for m, b in buckets.items()], "model string, bucket string, predicted double, q10 double, q90 double")
    return spark.createDataFrame(rows, COLUMNS), current, F.to_timestamp_ntz(F.lit(str(NOW)))


BUCKETS = {"a": "range:high", "b": "trending:high", "c": "unknown:unknown"}


def test_every_bucket_equals_a_loop(spark):
    rows = history()
    want, _ = looped(rows, NOW, POLICY)
    want["b", "trending:high"] = (0, want["b", "range:low"][2], want["b", "range:low"][2], None, False)
    got = {(r["model"], r["bucket"]): (r["samples"], r["multiplier"], r["marginal_multiplier"], r["coverage_after"], r["within_tolerance"]) for r in calibration.bucket_calibration(*frames(spark, rows, BUCKETS), ["model"], POLICY).collect()}
    assert got.keys() == want.keys()
    assert all(near(x, y) for k in want for x, y in zip(got[k], want[k]))


@pytest.mark.parametrize("bucket", ["range:low", "range:high", "trending:low"])
@pytest.mark.parametrize("loose", [True, False])
def test_the_section_falls_back_for_every_cause(spark, bucket, loose):
    rows = history(3)
    policy = calibration.Policy(limit=60, tolerance=0.10 if loose else 0.001, aggregate_tolerance=0.05 if loose else 0.0001)
    found, groups = looped(rows, NOW, policy)
    k, m, marginal, after, ok = found["a", bucket]
    sound = abs(groups["a"] - 0.8) <= policy.aggregate_tolerance + 1e-9
    reasons = [r for r, c in {"low_segment_evidence": k < 20, "selected_segment_coverage_unverified": not ok, "aggregate_coverage_tolerance": not sound}.items() if c]
    row = calibration.conditional_section(*frames(spark, rows, {"a": bucket}), ["model"], policy).collect()[0]
    assert row["fallback_reasons"] == reasons and near(row["aggregate_coverage"], groups["a"])
    applied = round(marginal if reasons else m, 4)
    assert near(row["applied_multiplier"], applied) and near(row["half_width"], 2 / round(marginal, 4) * applied)
    assert near(row["recalibrated_q90"], 100 + row["half_width"]) and near(row["recalibrated_q10"], 100 - row["half_width"])


def test_later_outcomes_change_nothing(spark):
    rows = history()
    changed = [(*r[:7], 1e6) if r[3] > NOW else r for r in rows]
    assert rows != changed
    one, two = (sorted(map(str, calibration.conditional_section(*frames(spark, r, BUCKETS), ["model"], POLICY).collect())) for r in (rows, changed))
    assert one == two


def test_no_history_and_no_price(spark):
    empty, current, now = frames(spark, [], {"a": "range:low"})
    row = calibration.conditional_section(empty, current.withColumn("predicted", F.lit(None).cast("double")), now, ["model"]).collect()[0]
    assert (row["samples"], row["mode"], row["applied_multiplier"], row["decision"]) == (0, "marginal_fallback", 1.0, "marginal_fallback")
    assert row["recalibrated_q10"] is None and row["fallback_reasons"] == ["low_segment_evidence", "selected_segment_coverage_unverified", "aggregate_coverage_tolerance"]
    assert calibration.conditional_section(empty, current.where("false"), now, ["model"]).count() == 0


def test_the_multiplier_already_in_an_interval_counts(spark):
    rows = history()
    row = calibration.conditional_section(*frames(spark, rows, BUCKETS), ["model"], POLICY, engine=F.lit(2.0)).where("model = 'a'").collect()[0]
    assert near(row["half_width"], row["applied_multiplier"])


@pytest.mark.parametrize("wrong", [{"target": 0.5}, {"limit": 0}, {"least": 0}, {"tolerance": 0.0}])
def test_policies_that_make_no_sense(wrong):
    with pytest.raises(ValueError):
        calibration.Policy(**wrong)


def test_report_over_horizons(spark):
    rows = [(2, "validated_segment", True, "conformal", [], 0.8, 1.0), (16, "marginal_fallback", False, "shrunken", ["x"], 0.6, 3.0), (4, "marginal_fallback", False, "conformal", [], None, None)]
    section = spark.createDataFrame(rows, "horizon int, decision string, verified boolean, mode string, violations array<string>, coverage_after double, width_after double").withColumn("model", F.lit("a"))
    row = calibration.coverage_width_report(section, "horizon", ["model"]).collect()[0]
    assert row["fallback_horizons"] == "4,16" and not row["all_validated"] and near(row["mean_coverage"], 0.7) and row["violation_buckets"] == 1 and row["sparse_horizons"] == 1


def test_conformal_ranks_scores_without_gathering_them(spark):
    rows = spark.createDataFrame(history(), COLUMNS).withColumn("within", (F.col("actual") >= F.col("q10")) & (F.col("actual") <= F.col("q90")))
    got = {r["model"]: r for r in evaluate.conformal(rows, 0.8, "model").collect()}
    for model in "ab":
        scores = [abs(r[7] - r[4]) / ((r[6] - r[5]) / 2) for r in history() if r[0] == model]
        covered = sum(s <= 1 for s in scores) / len(scores)
        want = higher(scores, 0.8) if len(scores) >= 20 else min(1.75, max(0.75, math.sqrt(0.8 / max(covered, 0.1))))
        assert got[model]["samples"] == len(scores) and near(got[model]["multiplier"], want)


@pytest.mark.parametrize("before", [None, 1.0, 2.5, 9.0])
def test_recalibration_moves_by_bounded_steps_of_the_present_bucket(spark, before):
    """Against rules written plainly: the bucket's coverage decides, and directions of all rows are alerted."""
    rows = history(7)
    policy = calibration.Policy(limit=60, tolerance=0.001)
    found, _ = looped(rows, NOW, policy)
    frame, current, now = frames(spark, rows, {"a": "range:high", "b": "range:low"})
    price = 100.5  # every forecast of 100 says down
    set_ = spark.createDataFrame([("a", before)] if before else [], "model string, multiplier double")
    got = {r["model"]: r for r in calibration.rolling_recalibration(frame.withColumn("source_price", F.lit(price)), current, set_, now, ["model"], policy).collect()}
    for model, bucket in (("a", "range:high"), ("b", "range:low")):
        k, m, _, after, ok = found[model, bucket]
        old, want = (before or 1.0) if model == "a" else 1.0, round(m, 4)
        status = "kept" if ok or k < policy.least else "unsafe_change" if abs(want - old) / old > 0.5 else "applied"
        hits = [r[7] - price < 0 for r in rows if r[0] == model and r[3] <= NOW]
        row = got[model]
        assert (row["samples"], row["status"], row["hits"]) == (k, status, len(hits)) and near(row["coverage"], after) and near(row["hit_rate"], sum(hits) / len(hits))
        assert near(row["after"], max(old * 0.9, min(want, old * 1.1)) if status == "applied" else old)
        drift = len(hits) >= 20 and sum(hits) / len(hits) < 0.45
        assert row["alerts"] == ["direction_drift"] * drift + [status] * (status == "unsafe_change")


def test_a_log_is_written_once_and_rolled_back(spark):
    frame, current, now = frames(spark, history(7), {"a": "range:high"})
    policy = calibration.Policy(limit=60, tolerance=0.001)
    set_ = spark.createDataFrame([("a", 2.5)], "model string, multiplier double")
    made = calibration.rolling_recalibration(frame.withColumn("source_price", F.lit(100.0)), current, set_, now, ["model"], policy)
    log = ledger.appended(calibration.audited(made, ["model"], now), None)
    assert [(r["key"], r["status"], r["before"]) for r in log.collect()] == [("a", "applied", 2.5)]
    assert ledger.appended(calibration.audited(made, ["model"], now), log).count() == 0
    held, said = ledger.rollback(made.select(F.col("model").alias("key"), F.col("after").alias("multiplier")), log, now + F.expr("INTERVAL 1 HOUR"))
    assert [tuple(r) for r in held.collect()] == [("a", 2.5)] and [r["status"] for r in said.collect()] == ["rolled_back"]
