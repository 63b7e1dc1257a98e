"""Fits from running moments equal plain refits on the rows known at each origin."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.moments import Design, Interaction, interaction_overall, interaction_report, linear_replay

START = datetime(2024, 1, 1)
NAMES = ("a", "b", "c", "g")
PRODUCT, GATED = Interaction("ab", ("a", "c"), ("b", "c")), Interaction("ag", ("a", "b"), gate="g")
DESIGNS = (Design("base", ("a", "b", "c")), Design("less", ("a",)), Design("product", ("a", "b", "c"), PRODUCT), Design("gated", ("a", "b", "c"), GATED))


def made(seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for s in ("x", "y"):
        x = rng.normal([50, 3, -2, 0], [8, 1, 2, 0], (150, 4))
        x[:, 3] = rng.random(150) < 0.4
        y = 0.1 * (x[:, 0] - 50) + (x[:, 0] - 50) * (x[:, 1] - 3) / 8 + rng.normal(0, 1, 150)
        for k in range(150):
            if rng.random() > 0.05:
                for h in (2, 5):
                    out.append((s, h, START + timedelta(hours=k), x[k].tolist(), float(y[k] + h) if k < 146 and rng.random() > 0.05 else None))
    return out


def columns_of(design, x, mean, sd):
    z = (x - mean) / sd
    cols = [x[:, NAMES.index(c)] for c in design.columns]
    if i := design.interaction:
        side = lambda group: z[:, [NAMES.index(n) for n in group]].mean(axis=1)
        cols.append(side(i.a) * (x[:, NAMES.index(i.gate)] if i.gate else side(i.b)))
    return np.stack(cols, axis=1)


def refit(design, x, y, test, penalty):
    sd = np.where(x.std(axis=0) < 1e-9, 1.0, x.std(axis=0))
    train, one = columns_of(design, x, x.mean(axis=0), sd), columns_of(design, test[None], x.mean(axis=0), sd)
    mean, scale = train.mean(axis=0), np.where(train.std(axis=0) < 1e-9, 1.0, train.std(axis=0))
    z = np.column_stack([np.ones(len(y)), (train - mean) / scale])
    eye = np.eye(z.shape[1]) * penalty
    eye[0, 0] = 0
    return float(np.concatenate([[1.0], ((one - mean) / scale)[0]]) @ np.linalg.solve(z.T @ z + eye, z.T @ y))


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "series string, horizon int, ts timestamp_ntz, x array<double>, y double").repartition(3)


def test_every_origin_equals_a_refit(rows, frame):
    out = {(r["series"], r["horizon"], r["ts"], r["design"]): r["prediction"] for r in linear_replay(frame, NAMES, DESIGNS, 1.0, 20, part_hours=36).collect()}
    checked = 0
    for s, h, at, test, _ in rows:
        seen = [r for r in rows if r[0] == s and r[1] == h and r[4] is not None and r[2] + timedelta(hours=h) <= at]
        for design in DESIGNS:
            if len(seen) < 20:
                assert (s, h, at, design.name) not in out
                continue
            want = refit(design, np.array([r[3] for r in seen]), np.array([r[4] for r in seen]), np.array(test), 1.0)
            assert out[(s, h, at, design.name)] == pytest.approx(want, rel=1e-6, abs=1e-8)
            checked += 1
    assert checked == len(out) > 1500


def test_parts_change_nothing(frame):
    one, other = ({(r["series"], r["horizon"], r["ts"], r["design"]): r["prediction"] for r in linear_replay(frame, NAMES, DESIGNS, 1.0, 20, part_hours=p).collect()} for p in (7, 10_000))
    assert one.keys() == other.keys() and all(one[k] == pytest.approx(other[k], rel=1e-7, abs=1e-9) for k in one)


def test_elastic_net_at_parts(rows, frame):
    """Fitted at the start of each part only: the optimum of its own objective on the rows known by then."""
    out = linear_replay(frame, NAMES, DESIGNS[:1], 0.05, 20, part_hours=24, method="elastic", every_origin=False).collect()
    assert len(out) > 200
    r = next(r for r in out if r["ts"] >= START + timedelta(hours=100))
    begin = START + timedelta(hours=24 * ((r["ts"] - START) // timedelta(hours=24)))
    seen = [q for q in rows if q[0] == r["series"] and q[1] == r["horizon"] and q[4] is not None and q[2] + timedelta(hours=q[1]) < begin]
    x, y = np.array([q[3][:3] for q in seen]), np.array([q[4] for q in seen])
    mean, sd = x.mean(axis=0), x.std(axis=0)
    z, w = (x - mean) / sd, np.zeros(3)
    for _ in range(500):
        for k in range(3):
            rho = z[:, k] @ (y - y.mean() - z @ w + z[:, k] * w[k]) / len(y)
            w[k] = np.sign(rho) * max(abs(rho) - 0.03, 0) / (1 + 0.02)
    test = next(q[3][:3] for q in rows if q[0] == r["series"] and q[2] == r["ts"])
    assert r["prediction"] == pytest.approx(float(y.mean() + ((np.array(test) - mean) / sd) @ w), rel=1e-5)


def test_later_outcomes_change_nothing(frame):
    cut = F.lit(START + timedelta(hours=90))
    other = frame.withColumn("y", F.when(F.col("ts") + F.make_dt_interval(F.lit(0), F.col("horizon")) > cut, 1e6).otherwise(F.col("y")))
    early = lambda df: sorted((r["series"], r["horizon"], r["ts"], r["design"], r["prediction"]) for r in linear_replay(df, NAMES, DESIGNS, 1.0, 20, 36).where(F.col("ts") <= cut).collect())
    assert early(other) == early(frame)


def test_report_finds_the_interaction(frame):
    designs = (*DESIGNS[:2], Design("plain", ("a", "b", "c"), Interaction("a and b", ("a",), ("b",))))
    found = interaction_report(linear_replay(frame, NAMES, designs, 1.0, 20, 36), "base", 60, 3, 3, 1, 5)
    report = {(r["series"], r["horizon"], r["design"]): r for r in found.collect()}
    assert len(report) == 8 and all(report[(s, h, "plain")]["status"] == "promoted" and report[(s, h, "less")]["mean_gain"] < report[(s, h, "plain")]["mean_gain"] for s in "xy" for h in (2, 5))
    overall = {(r["series"], r["design"]): (r["recommendation"], r["promotion"]) for r in interaction_overall(found).collect()}
    assert overall[("x", "plain")] == ("edge_detected", "promoted") and overall[("y", "less")][1] != "promoted"


def test_empty(spark):
    none = spark.createDataFrame([], "series string, horizon int, ts timestamp_ntz, x array<double>, y double")
    assert linear_replay(none, NAMES, DESIGNS).collect() == []
