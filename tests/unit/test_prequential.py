"""Replays of weighting policies equal a loop over origins that looks only at what was known there."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate, prequential as pq

START = datetime(2024, 1, 1)
PRIORS = {"": {"persistence": 2.0, "a": 1.0, "b": 3.0}, "trending": {"persistence": 1.0, "a": 2.0, "b": 1.0}}
COLUMNS = "series string, origin_at timestamp_ntz, horizon int, model string, regime string, source_price double, predicted double, actual double, target_at timestamp_ntz, abs_pct double, signed_pct double, direction_correct int, within boolean"


def made(seed=3, hours=110):
    rng = np.random.default_rng(seed)
    out = []
    for series in ("x", "y"):
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, hours)))
        regime = rng.choice(["range", "trending", "high_volatility"], hours, p=[0.7, 0.25, 0.05])
        for t in range(hours):
            if rng.random() < 0.05:
                continue
            for horizon in (2, 4):
                actual = float(price[t + horizon]) if t + horizon < hours and rng.random() > 0.05 else None
                for model, noise in (("persistence", 0.0), ("a", 0.012), ("b", 0.02)):
                    p = float(price[t] * math.exp(rng.normal(0, noise))) if noise else float(price[t])
                    err = None if actual is None else (p - actual) / actual * 100
                    known = actual is not None
                    out.append((series, START + timedelta(hours=t), horizon, model, str(regime[t]), float(price[t]), p, actual, START + timedelta(hours=t + horizon),
                                abs(err) if known else None, err, int((p - price[t] > 0.005) == (actual - price[t] > 0.005)) if known else None, bool(abs(err) < 1.5) if known and rng.random() < 0.9 else None))
    return out


def normalised(raw, floor, cap):
    n = len(raw)
    if floor * n > 1 or cap * n < 1:
        return [1 / n] * n
    low, high = 0.0, cap / min(raw)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(cap, max(floor, mid * r)) for r in raw) < 1 else (low, mid)
    return [min(cap, max(floor, high * r)) for r in raw]


def measured(rows, limit):
    rows = sorted(rows, key=lambda r: r[8])[-limit:]
    if not rows:
        return {"n": 0}
    cover = [r[12] for r in rows if r[12] is not None]
    mean = lambda k: sum(r[k] for r in rows) / len(rows)
    return {"n": len(rows), "mae": mean(9), "bias": mean(10), "right": mean(11), "coverage": sum(cover) / len(cover) if cover else None, "intervals": len(cover)}


def learned(history, models, regime, limit, confidence):
    """(source, stats, weights) by plain loops over what was known."""
    prior = {m: PRIORS.get(regime, PRIORS[""])[m] for m in models}
    prior = {m: w / sum(prior.values()) for m, w in prior.items()}
    own = {m: measured([r for r in history if r[3] == m and r[4] == regime], limit) for m in models}
    whole = {m: measured([r for r in history if r[3] == m], limit) for m in models}
    enough = lambda s: min(x["n"] for x in s.values()) >= 6
    source, stats = ("regime", own) if enough(own) else ("all_regimes", whole) if enough(whole) else ("insufficient_history", whole)
    if source != "insufficient_history" and confidence <= 0:
        source = "drift_fallback"
    if source in ("insufficient_history", "drift_fallback"):
        return source, stats, prior
    naive, raw = stats["persistence"]["mae"], {}
    for m, s in stats.items():
        score = math.exp(-2.5 * s["mae"]) * (1 + 0.25 * (s["right"] - 0.5) * 2) * math.exp(-0.35 * abs(s["bias"]))
        score *= math.exp(-0.35 * abs(s["coverage"] - 0.8)) if s["intervals"] >= 3 else 1
        raw[m] = max(1e-9, score * (math.exp(1.5 * (naive - s["mae"])) if m != "persistence" and s["mae"] > naive else 1))
    blend = confidence * (0.25 + 0.55 * min(1, (min(s["n"] for s in stats.values()) - 6) / 18))
    mixed = {m: (1 - blend) * prior[m] + blend * raw[m] / sum(raw.values()) for m in models}
    others = [s["mae"] for m, s in stats.items() if m != "persistence"]
    mixed["persistence"] += 0.12 * (sum(others) / len(others) >= naive)
    return source, stats, dict(zip(models, normalised([mixed[m] for m in models], 0.03, 0.55)))


def price_of(rows, weights):
    base = rows[0][5]
    return base * math.exp(sum(weights[r[3]] * math.log(r[6] / base) for r in rows) / sum(weights.values()))


def origins(data):
    for key in sorted({(r[0], r[1]) for r in data}):
        yield key, {h: sorted([r for r in data if (r[0], r[1], r[2]) == (*key, h)], key=lambda r: r[3]) for h in (2, 4)}


@pytest.fixture(scope="module")
def data():
    return made()


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, COLUMNS).repartition(3)


def test_specialists_equal_a_loop(data, frame):
    out = {(r["series"], r["origin_at"], r["horizon"]): r for r in pq.specialist_replay(frame, PRIORS).collect()}
    for (series, at), by in origins(data):
        seen = [r for r in data if r[0] == series and r[8] <= at and r[7] is not None]
        base = {h: learned([r for r in seen if r[2] == h], ["a", "b", "persistence"], by[h][0][4], 200, 1.0) for h in by}
        sparse = any(b[0] == "insufficient_history" for b in base.values())
        for h, rows in by.items():
            regime, got = rows[0][4], out[(series, at, h)]
            e = pq.EXPERTS[regime]
            assert got["base_source"] == base[h][0] and got["fallback"] == ("sparse_history" if sparse else None) and got["expert"] == ("fallback" if sparse else regime)
            assert got["baseline"] == pytest.approx(price_of(rows, base[h][2]), rel=1e-9)
            if sparse:
                _, _, prior = learned([], ["a", "b", "persistence"], regime, 200, 1.0)
                raw, cap = {m: 0.5 * w + 0.5 / 3 for m, w in prior.items()}, 0.55
            else:
                _, stats, raw = learned([r for r in seen if r[2] == h], ["a", "b", "persistence"], regime, e.limit, e.confidence)
                naive, others = stats["persistence"]["mae"], [stats[m]["mae"] for m in "ab"]
                raw = {m: w * (1 + e.reward * (stats[m]["right"] - 0.5) * 2) + (e.boost if m == "persistence" and sum(others) / 2 >= naive else 0) for m, w in raw.items()}
                cap = min(0.55, max(e.cap, 1 / 3 + 1e-6))
            weights = dict(zip("a b persistence".split(), normalised([raw[m] for m in "a b persistence".split()], 0.03, cap)))
            assert got["candidate"] == pytest.approx(price_of(rows, weights), rel=1e-9)


def test_later_outcomes_change_nothing(spark, data, frame):
    """What an origin gets doesn't depend on any outcome whose target lies after it."""
    cut = START + timedelta(hours=70)
    other = [(*r[:7], r[7] * 3, r[8], 200.0, 200.0, 1 - r[11], None) if r[7] is not None and r[8] > cut else r for r in data]
    kept = ["series", "origin_at", "horizon", "baseline", "candidate", "expert"]
    early = lambda df: sorted(map(tuple, pq.specialist_replay(df, PRIORS).where(F.col("origin_at") <= F.lit(cut)).select(*kept).collect()))
    assert early(spark.createDataFrame(other, COLUMNS)) == early(frame)


def drift_grade(values):
    if len(values) < 32:
        return 0
    x, y = values[-8:], values[-32:-8]
    mid = lambda v: float(np.median(v))
    scale = max(1.4826 * mid([abs(v - mid(y)) for v in y]), 0.1 * abs(mid(y)), 1e-6)
    ks = max(abs(np.mean([a <= v for a in x]) - np.mean([b <= v for b in y])) for v in x + y)
    grade = lambda v, lo, hi: 2 if v >= hi else 1 if v >= lo else 0
    return max(grade(round(abs(mid(x) - mid(y)) / scale, 6), 2.0, 3.5), grade(round(ks, 6), 0.35, 0.55))


def test_recency_policies_equal_a_loop(spark, data, frame):
    points = frame.select("series", F.col("origin_at").alias("ts")).distinct()
    folded = evaluate.folds(points, 2, 4, 1, 10)
    out = {(r["fold"], r["series"], r["origin_at"], r["horizon"], r["policy"]): r for r in pq.recency_replay(frame, folded, PRIORS).collect()}
    roles = {}
    for r in folded.collect():
        roles.setdefault((r["fold"], r["series"]), {})[r["ts"]] = r["role"]
    models, checked, last = ["a", "b", "persistence"], 0, {}
    for (fold, series), role in sorted(roles.items()):
        for (s, at), by in origins(data):
            if s != series or role.get(at) != "validate":
                continue
            seen = [r for r in data if r[0] == series and r[1] in role and r[8] <= at and r[7] is not None]
            grade = max(drift_grade([r[9] for r in sorted([r for r in seen if r[2] == h and r[3] == m], key=lambda r: r[8])]) for h in (2, 4) for m in models)
            confidence = {0: 1.0, 1: 0.5, 2: 0.0}[grade]
            for h, rows in by.items():
                regime, history = rows[0][4], sorted([r for r in seen if r[2] == h], key=lambda r: r[8])
                production = learned(history, models, regime, 200, confidence)[2]
                choices = {"production": (production, None, 0, 0), "persistence": ({"a": 0.0, "b": 0.0, "persistence": 1.0}, None, 0, 0)}
                for p in pq.DECAYS:
                    own, whole = ({m: [r for r in history if r[3] == m and (not only or r[4] == regime)][-p.window :] for m in models} for only in (True, False))
                    enough = lambda s: min(map(len, s.values())) >= 6
                    if not enough(own) and not enough(whole):
                        choices[p.name] = (production, None, 1, 0)
                        continue
                    picked, raw, worth, aged, total = own if enough(own) else whole, {}, [], 0.0, 0.0
                    for m, mine in picked.items():
                        age = np.arange(len(mine))[::-1]
                        w = {"rolling": np.ones(len(mine)), "exponential": 0.5 ** (age / max(1, p.life)), "linear": np.clip(1 - age / max(1, p.life), 0, 1)}[p.technique]
                        mean = lambda k: float((w * [r[k] for r in mine]).sum() / w.sum())
                        cover = [r[12] for r in mine if r[12] is not None]
                        score = math.exp(-2.5 * mean(9)) * (1 + 0.5 * 0.5 * (mean(11) - 0.5) * 2) * math.exp(-0.35 * abs(mean(10)))
                        raw[m] = max(1e-9, score * (math.exp(-0.35 * abs(np.mean(cover) - 0.8)) if len(cover) >= 3 else 1))
                        worth.append(float(w.sum() ** 2 / (w * w).sum()))
                        aged, total = aged + float((w * age).sum()), total + float(w.sum())
                    blend = p.blend * min(1, max(0, (min(worth) - 6) / 18)) * confidence
                    delta = {m: blend * (raw[m] / sum(raw.values()) - production[m]) for m in models}
                    far = max(map(abs, delta.values()))
                    choices[p.name] = ({m: production[m] + delta[m] * (min(1, p.shift / far) if far else 0) for m in models}, aged / total, 0, int(far > p.shift))
                for name, (weights, memory, anchored, capped) in choices.items():
                    got = out[(fold, series, at, h, name)]
                    assert (got["anchored"], got["capped"], got["segment"]) == (anchored, capped, "drift" if grade else "normal")
                    assert got["memory"] == (None if memory is None else pytest.approx(memory, rel=1e-9))
                    if rows[0][7] is not None:
                        assert got["error"] == pytest.approx(abs(price_of(rows, weights) - rows[0][7]) / rows[0][7] * 100, rel=1e-6, abs=1e-9)
                    before = last.get((fold, series, h, name))
                    assert got["turnover"] == (None if before is None else pytest.approx(sum(abs(before[m] - weights[m]) for m in models), abs=1e-9))
                    last[(fold, series, h, name)], checked = weights, checked + 1
    assert checked == len(out) > 500


def test_uncertainty_equals_a_loop(data, frame):
    c = pq.Uncertainty(limit=40, least=6, full=20, evidence=15, ratio=1.2)
    out = {(r["series"], r["origin_at"], r["horizon"]): r for r in pq.uncertainty_replay(frame, PRIORS, c).collect()}
    clipped = 0
    for (series, at), by in origins(data):
        for h, rows in by.items():
            got, models = out[(series, at, h)], ["a", "b", "persistence"]
            seen = sorted([r for r in data if r[0] == series and r[2] == h and r[8] <= at and r[7] is not None], key=lambda r: r[8])
            source, _, base = learned(seen, models, rows[0][4], 200, 1.0)
            raw, info = {}, {}
            for m in models:
                hits = [r[12] for r in [r for r in seen if r[3] == m][-40:] if r[12] is not None]
                cover = sum(hits) / len(hits) if hits else None
                penalty = 1 - 0.7 * min(1, (len(hits) - 6) / 14) * (1 - math.exp(-2 * abs(cover - 0.8))) if len(hits) >= 6 else 1.0
                info[m] = (len(hits), len(hits) >= 6 and cover < 0.7)
                raw[m] = base[m] * penalty
                mine = next(x for x in got["calibration"] if x["model"] == m)
                assert (mine["samples"], mine["overconfident"]) == info[m] and mine["penalty"] == pytest.approx(penalty)
            top = sorted(raw, key=lambda m: (raw[m], info[m][0] >= 15 and not info[m][1], m), reverse=True)
            if not (info[top[0]][0] >= 15 and not info[top[0]][1]) and raw[top[0]] > 1.2 * raw[top[1]]:
                raw[top[0]] = 1.2 * raw[top[1]]
                clipped += 1
            weights = base if source == "insufficient_history" else dict(zip(models, normalised([raw[m] for m in models], 0.03, 0.55)))
            assert got["candidate"] == pytest.approx(price_of(rows, weights), rel=1e-9)
    assert clipped > 20


def test_stack_equals_a_fit_on_training_rows(spark, frame):
    points = frame.select("series", F.col("origin_at").alias("ts")).distinct()
    folded = evaluate.folds(points, 2, 4, 1, 10)
    replay = pq.specialist_replay(frame, PRIORS, spans={2: 10, 4: 20})
    replay = spark.createDataFrame(replay.collect(), replay.schema)
    roles = {}
    for r in folded.collect():
        roles.setdefault((r["fold"], r["series"]), {})[r["ts"]] = r["role"]
    rows = [r for r in replay.collect() if r["actual"] is not None]
    out = {(r["fold"], r["series"], r["origin_at"], r["horizon"]): r for r in pq.stack_replay(replay, folded).collect()}
    checked = 0
    for (fold, series), role in roles.items():
        for h in (2, 4):
            mine = [r for r in rows if r["series"] == series and r["horizon"] == h]
            x = lambda r: [r[c] / r["source_price"] - 1 for c in pq.SPECIALISTS]
            train = [r for r in mine if role.get(r["origin_at"]) == "train"]
            a, y = np.array([x(r) for r in train]), np.array([r["actual"] / r["source_price"] - 1 for r in train])
            w = pq.simplex_fit(a.T @ a, a.T @ y)
            assert w.min() >= 0 and w.sum() == pytest.approx(1)
            for r in mine:
                if role.get(r["origin_at"]) == "validate":
                    got = out[(fold, series, r["origin_at"], h)]
                    assert got["trained"] == len(train) and got["stacked"] == pytest.approx(sum(v * r[c] for v, c in zip(w, pq.SPECIALISTS)), rel=1e-9)
                    checked += 1
    assert checked == len(out) > 100
    assert pq.stack_report(pq.stack_replay(replay, folded), 32, 4, "horizon").where("segment = 'overall'").count() == 4


def longest_condition(df):
    """Characters of the longest filter condition in the optimised plan."""
    longest, nodes = 0, [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Filter":
            longest = max(longest, len(node.condition().toString()))
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return longest


def test_reports_put_no_replay_into_a_condition(frame):
    """A condition on an error is not pushed down to the sources with the whole replay written out in it."""
    folded = evaluate.folds(frame.select("series", F.col("origin_at").alias("ts")).distinct(), 2, 4, 1, 10)
    stacked = pq.stack_replay(pq.specialist_replay(frame, PRIORS, spans={2: 10, 4: 20}), folded)
    assert 0 < longest_condition(pq.stack_report(stacked, 32, 4, "horizon")) < 2000
    assert longest_condition(pq.paired_report(pq.uncertainty_replay(frame, PRIORS), 32, 4, "horizon")) < 2000


def test_reports_skip_rows_without_both_errors(spark):
    rows = [("g", START + timedelta(hours=k), None if k % 5 == 0 else 3.0 + k % 3, None if k % 7 == 0 else 2.0 + k % 2, 1, 0) for k in range(60)] + [("none", START, None, 1.0, 1, 1)]
    frame = spark.createDataFrame(rows, "g string, origin_at timestamp_ntz, baseline_error double, candidate_error double, baseline_right int, candidate_right int")
    (got,) = pq.paired_report(frame, 8, 4, "g").collect()
    known = [r for r in rows if r[2] is not None and r[3] is not None]
    assert (got["g"], got["pairs"], got["mean_gain"]) == ("g", len(known), pytest.approx(sum(r[2] - r[3] for r in known) / len(known)))
    assert got["baseline_mae"] == pytest.approx(sum(r[2] for r in known) / len(known))


def test_reports(frame):
    report = pq.paired_report(pq.specialist_replay(frame, PRIORS), 32, 4, "series", "horizon").collect()
    assert len(report) == 4 and all(r["verdict"] in ("candidate_better", "baseline_better", "inconclusive", "low_sample") for r in report)
    folded = evaluate.folds(frame.select("series", F.col("origin_at").alias("ts")).distinct(), 2, 4, 1, 10)
    table = pq.recency_report(pq.recency_replay(frame, folded, PRIORS), 32, 4, "horizon").collect()
    assert len(table) == 2 * 7 and all((r["z"] is None) or r["policy"] != "production" for r in table)


def test_empty(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert pq.specialist_replay(none, PRIORS).collect() == []
