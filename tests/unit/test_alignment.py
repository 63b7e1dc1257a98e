"""Aligned sources against one as-of join for each and against a loop, with parts of any length."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import alignment, pit

START = dt.datetime(2024, 3, 1)
AT = lambda minutes: START + dt.timedelta(minutes=minutes)


def drawn(seed=5):
    draw = random.Random(seed)
    origins = [(draw.choice("ab"), AT(draw.randrange(-500, 5000)), k) for k in range(200)]
    slow = [(draw.choice("ab"), AT(480 * k), draw.random()) for k in range(12)]
    fast = [(draw.choice("abc"), AT(draw.randrange(4000)), draw.choice([draw.random(), None, math.nan])) for _ in range(300)]
    return origins, slow, fast


def frames(spark, origins, slow, fast):
    rows = lambda r, v: spark.createDataFrame(r, f"series string, ts timestamp_ntz, {v}")
    return rows(origins, "id int"), [alignment.Source("slow", rows(slow, "level double"), ("level",)), alignment.Source("fast", rows(fast, "value double"), ("value",), 1800)]


def key(v):
    return (v is not None, str(v) == "nan", v if v is not None and v == v else 0)


def looped(origins, slow, fast):
    out = {}
    for series, at, ident in origins:
        found = []
        for rows, most in ((slow, None), (fast, 1800)):
            past = sorted(((t, key(v), v) for s, t, v in rows if s == series and t <= at), key=lambda r: r[:2])
            fresh = past and (most is None or (at - past[-1][0]).total_seconds() <= most)
            found += [past[-1][0], str(past[-1][2])] if fresh else [None, "None"]
        out[ident] = tuple(found)
    return out


@pytest.mark.parametrize("part", [3600, 7 * 86400, 10**9])
def test_equals_a_loop_for_any_parts(spark, part):
    origins, sources = frames(spark, *drawn())
    got = {r["id"]: (r["slow_at"], str(r["slow_level"]), r["fast_at"], str(r["fast_value"])) for r in alignment.aligned(origins, sources, "series", "ts", part).collect()}
    assert got == looped(*drawn())


def test_equals_one_join_for_each_source(spark):
    origins, slow, _ = drawn()
    frame, sources = frames(spark, origins, slow, [])
    want = {(r["id"], r["found"] and r["found"]["value"]) for r in pit.as_of(frame, sources[0].rows, "series", "ts", F.col("level")).collect()}
    assert {(r["id"], r["slow_level"]) for r in alignment.aligned(frame, sources, "series", "ts").collect()} == want


def test_a_later_row_is_never_seen(spark):
    origins, slow, fast = drawn()
    cut = AT(2000)
    later = [(s, t, -1.0) if t > cut else (s, t, v) for s, t, v in slow]
    early = [o for o in origins if o[1] <= cut]
    one, two = (sorted(map(str, alignment.aligned(*frames(spark, early, rows, fast), "series", "ts").collect())) for rows in (slow, later))
    assert one == two


def test_ties_repeats_nulls_and_nothing(spark):
    origins = [("a", AT(10), 1), (None, AT(10), 2), ("a", None, 3), ("a", AT(10), 1)]
    slow = [("a", AT(10), 1.0), ("a", AT(10), 2.0), ("a", AT(10), None), (None, AT(5), 9.0), ("a", None, 9.0)]
    for part in (60, 10**9):
        frame, sources = frames(spark, origins, slow, [])
        out = sorted((r["id"], r["slow_level"], r["fast_at"]) for r in alignment.aligned(frame, sources, "series", "ts", part).collect())
        assert out == [(1, 2.0, None), (1, 2.0, None), (2, None, None), (3, None, None)]
    assert alignment.aligned(*frames(spark, [], slow, []), "series", "ts").count() == 0


def test_names_that_clash_stay_apart(spark):
    frame = spark.createDataFrame([("a", AT(10), 1.0)], "series string, ts timestamp_ntz, level double")
    sources = frames(spark, [], [("a", AT(1), 7.0)], [])[1]
    row = alignment.aligned(frame, sources, "series", "ts").collect()[0]
    assert (row["level"], row["slow_level"]) == (1.0, 7.0)


def test_what_is_missing_is_named(spark):
    rows = [(1.0, 1.0, 1.0), (None, 1.0, math.inf), (math.nan, None, 1.0), (1.0, 1.0, math.nan)]
    sources = frames(spark, [], [], [])[1]
    out = alignment.completed(spark.createDataFrame(rows, "x double, slow_level double, fast_value double"), ["x"], sources).collect()
    assert [r["missing"] for r in out] == [[], ["base", "fast"], ["base", "slow"], ["fast"]]
    assert [r["complete"] for r in out] == [True, False, False, False]


def test_a_source_that_tells_the_outcome_is_found(spark):
    draw = random.Random(2)
    rows = []
    for k in range(400):
        told, noise, own = draw.gauss(0, 1), draw.gauss(0, 1), draw.gauss(0, 1)
        rows.append(("a", 2, START + dt.timedelta(hours=k), [own, told, noise], told + 0.2 * draw.gauss(0, 1)))
    frame = spark.createDataFrame(rows, "series string, horizon int, ts timestamp_ntz, x array<double>, y double")
    sources = frames(spark, [], [], [])[1]
    found = {r["design"]: r for r in alignment.source_report(frame, ["own"], sources, least=48).collect()}
    assert found.keys() == {"slow", "fast", "all"}
    assert found["slow"]["relative_gain"] > 0.5 and found["all"]["relative_gain"] > 0.5 and abs(found["fast"]["relative_gain"]) < 0.1
