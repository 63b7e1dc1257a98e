"""Queries over whole tables, whose SQL keeps to a part, against plain Python."""

import base64
import json
import os

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import inference
from tidemark.plans import registry

DATA = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def expected(df):
    """Of each family: rejections by four corrections and the mean Bonferroni p-value, one window each."""
    out = {}
    for name, part in df.groupby("family"):
        p = np.sort(part["p"].to_numpy())
        m, r = len(p), np.arange(1, len(p) + 1)
        fails = np.flatnonzero(p > 0.05 / (m - r + 1))
        passes = np.flatnonzero(p <= r * 0.05 / (m * (1 / r).sum()))
        out[name] = (int((p <= 0.05 / m).sum()), int((p <= 1 - 0.95 ** (1 / m)).sum()), int(fails[0]) if len(fails) else m, int(passes[-1]) + 1 if len(passes) else 0, round(float(np.minimum(p * m, 1).mean()), 6))
    return out


def lines():
    t = pd.read_parquet(f"{DATA}/lineitem.parquet")
    p = (t["l_extendedprice"].astype(float) * 7919 % 100000) / 100000 * t["l_discount"].astype(float)
    return pd.DataFrame({"family": t["l_returnflag"], "id": t["l_orderkey"] * 10 + t["l_linenumber"], "p": p})


@data
def test_families_of_all_orders(spark):
    df = lines()
    ranked = sorted(map(tuple, registry.queries()["family_rank_whole"](spark, DATA).select("family", "id", "family_rank").collect()))
    df["r"] = df.groupby("family")["p"].rank(method="min").astype(int)
    assert ranked == sorted(zip(df["family"], df["id"], df["r"]))  # ids come more than once
    tested = {r["family"]: (r["bonferroni"], r["sidak"], r["holm"], r["by"], r["mean_adjusted"]) for r in registry.queries()["multiple_testing_whole"](spark, DATA).collect()}
    assert tested == expected(df)


def test_ranks_with_ties_and_nulls(spark):
    rng = np.random.default_rng(3)
    rows = [("a", i, float(x)) for i, x in enumerate(np.round(rng.random(3000) ** 6, 3))] + [("b", i, 0.5) for i in range(500)] + [(None, 1, 0.1), ("c", 1, None), ("c", 2, 0.2)]
    got = inference.ranks(spark.createDataFrame(rows, "family string, id long, p double").repartition(7), ["family"]).collect()
    assert sorted((r["family"] or "", r["id"]) for r in got) == sorted((f or "", i) for f, i, _ in rows)
    for name in ("a", "b", "c", None):
        part = sorted((r for r in got if r["family"] == name), key=lambda r: r["rank"])
        p = [-1.0 if r["p"] is None else r["p"] for r in part]
        assert p == sorted(p) and [r["rank"] for r in part] == list(range(1, len(p) + 1)) and {r["comparisons"] for r in part} == {len(p)}
        assert [r["tied"] for r in part] == [p.index(x) + 1 for x in p]


def test_ranks_of_values_that_fill_many_ranges(spark):
    rng = np.random.default_rng(4)
    p = [None] * 900 + [0.2] * 2500 + [0.5] * 1500 + [float("nan")] * 40 + [0.0, -0.0] * 20 + [float(x) for x in rng.random(1500)]
    frame = spark.createDataFrame([(f, i, x) for f in ("a", None) for i, x in enumerate(p)] + [("same", 1, 0.3)] * 400, "family string, id long, p double")
    got = inference.ranks(frame.repartition(5), ["family"]).collect()
    place = lambda x: (0, 0.0) if x is None else (2, 0.0) if x != x else (1, x)
    for name, values in (("a", p), (None, p), ("same", [0.3] * 400)):
        part, ordered = sorted((r for r in got if r["family"] == name), key=lambda r: r["rank"]), sorted(map(place, values))
        assert [place(r["p"]) for r in part] == ordered and [r["rank"] for r in part] == list(range(1, len(values) + 1)) and {r["comparisons"] for r in part} == {len(values)}
        first = {x: k + 1 for k, x in reversed(list(enumerate(ordered)))}
        assert [r["tied"] for r in part] == [first[place(r["p"])] for r in part]


def test_rejections_are_counted_in_one_ranking(spark):
    rng = np.random.default_rng(5)
    rows = [("some", i, float(x)) for i, x in enumerate(rng.random(900) ** 9)] + [("some", -1 - i, None) for i in range(7)] + [("all", i, 1e-9) for i in range(50)] + [("none", i, 0.9) for i in range(50)] + [("null", i, None) for i in range(3)] + [(None, 1, 0.01)]
    frame = spark.createDataFrame(rows, "family string, id long, p double").repartition(3)
    methods = ("bonferroni", "sidak", "holm", "by")
    counts = inference.rejection_counts(frame, methods, 0.05, ["family"], ["holm"])
    got = {r["family"]: r for r in counts.collect()}
    for m in methods:
        each = {}
        for r in inference.family(frame, m, 0.05, ["family"]).collect():
            each.setdefault(r["family"], []).append(r)
        assert {f: r[m] for f, r in got.items()} == {f: sum(bool(r["rejected"]) for r in part) for f, part in each.items()}
        if m == "holm":
            means = {f: [r["adjusted_p"] for r in part if r["adjusted_p"] is not None] for f, part in each.items()}
            assert all(got[f]["mean_holm"] == pytest.approx(sum(x) / len(x)) if x else got[f]["mean_holm"] is None for f, x in means.items())
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1  # it was one for each method, and one more for Holm's and Yekutieli's ends


@data
def test_all_signups_and_orders(spark):
    e = pd.read_parquet(f"{DATA}/events.parquet")
    signups, ts = e[e["event_type"] == "signup"], e["ts"].to_numpy()
    got = {r["span_id"]: (r["events"], r["value"]) for r in registry.queries()["range_join_whole"](spark, DATA).collect()}
    assert set(got) == set(signups["event_id"]) and any(u % 20 for u in signups["user_id"])
    for i, t in zip(signups["event_id"], signups["ts"].to_numpy()):
        inside = e[(ts >= t) & (ts < t + np.timedelta64(3, "h"))]
        assert got[i][0] == len(inside) and abs(got[i][1] - inside["value"].sum()) < 1e-3
    at = np.sort(signups["ts"].to_numpy())
    near = registry.queries()["nearest_event_segments_whole"](spark, DATA).toPandas()
    assert len(near) == e["ts"].dt.floor("h").nunique()
    for t, found, segment in zip(near["ts"].to_numpy(), near["nearest_at"].to_numpy(), near["segment"]):
        best = at[np.argmin(np.abs(at - t))]
        assert found == best and segment == ("non_event" if abs(best - t) > np.timedelta64(6, "h") else "pre_event" if best > t else "post_event")
    orders, items = pd.read_parquet(f"{DATA}/orders.parquet"), pd.read_parquet(f"{DATA}/lineitem.parquet")
    missing = [r["o_orderkey"] for r in registry.queries()["missing_keys_whole"](spark, DATA).collect()]
    assert sorted(missing) == sorted(set(orders["o_orderkey"]) - set(items.loc[items["l_quantity"] > 30, "l_orderkey"])) and any(k % 2 for k in missing)


@data
def test_all_events(spark):
    e = pd.read_parquet(f"{DATA}/events.parquet")
    got = {r["event_id"]: (r["cursor"], r["back"]) for r in registry.queries()["opaque_cursors_whole"](spark, DATA).collect()}
    assert set(got) == set(e["event_id"])
    for i, kind in zip(e["event_id"], e["event_type"]):
        said = json.loads(base64.urlsafe_b64decode(got[i][0] + "=" * (-len(got[i][0]) % 4)))
        assert said == {"filters": {"type": kind}, "key": i} and got[i][1] == i
    ages = {r["event_type"]: (r["age_seconds"], r["state"]) for r in registry.queries()["freshness_check_whole"](spark, DATA).collect()}
    newest = e.groupby("event_type")["ts"].max().dt.floor("s")
    age = {k: int((pd.Timestamp("2024-01-31") - t).total_seconds()) for k, t in newest.items()}
    assert ages == {k: (a, "fresh" if a <= 3600 else "late" if a <= 14400 else "stale") for k, a in age.items()}
