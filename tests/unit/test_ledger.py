import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger


def hour(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)


def made(spark):
    rows = [(s, hour(k), h, m, 1.0 + k / 7 if m != "b" or k % 5 else None, 2.0 + k / 3 if k % 4 else None, hour(k + h), abs(k - 3.0)) for s in "xy" for k in range(60) for h in (2, 16) for m in "ab"]
    return rows, spark.createDataFrame(rows, "series string, origin_at timestamp_ntz, horizon int, model string, predicted double, actual double, target_at timestamp_ntz, abs_pct double")


def test_only_whole_origins_are_frozen(spark):
    rows, df = made(spark)
    out = ledger.frozen_origins(df, F.lit(hour(40)))
    assert {r["origin_at"] for r in out.collect()} == {hour(k) for k in range(25)} and out.count() == 2 * 25 * 4


def test_the_digest_depends_on_rows_alone(spark):
    rows, df = made(spark)
    of = lambda d: sorted(map(tuple, ledger.cohort_digest(d, ["horizon", "model"], ["predicted", "actual"]).collect()))
    want = of(df)
    assert of(df.repartition(7)) == of(df.orderBy(F.desc("origin_at"))) == want
    assert of(df.withColumn("actual", F.when((F.col("series") == "x") & (F.col("horizon") == 2) & (F.col("model") == "a") & (F.col("origin_at") == F.lit(hour(9))), 55.0).otherwise(F.col("actual"))))[0] != want[0]
    text = lambda v: "" if v is None else str(int(v * 10_000 + 0.5))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    days = {}
    for s, at, h, m, p, a, _, _ in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        if s == "x":
            t = int(at.replace(tzinfo=dt.timezone.utc).timestamp())
            days.setdefault(t // 86400, []).append(sha(f"{t}|{h}|{m}|{text(p)}|{text(a)}"))
    assert want[0][4] == sha("".join(sha("".join(d)) for _, d in sorted(days.items())))


def test_evidence(spark):
    _, df = made(spark)
    out = {(r["model"], r["horizon"]): r for r in ledger.cohort_evidence(df.where("series = 'x'"), "a", "horizon").collect()}
    b = out[("b", 2)]
    assert (b["attempts"], b["failures"], b["exact"], b["paired"], b["wins"]) == (60, 12, 36, 36, 0) and b["mae"] == b["baseline_mae"]


def test_two_runs_append_once_and_rollbacks_are_logged(spark):
    changes = spark.createDataFrame([("a", "applied", 1.0, 1.1), ("b", "kept", 1.0, 1.0)], "key string, status string, before double, after double")
    log = ledger.appended(ledger.entries(changes, F.lit(hour(1))), None)
    assert log.count() == 2 and ledger.appended(ledger.entries(changes, F.lit(hour(1))), log).count() == 0
    later = ledger.entries(spark.createDataFrame([("a", "applied", 1.1, 1.2)], changes.schema), F.lit(hour(2)))
    log = log.select(*ledger.ENTRY).unionByName(ledger.appended(later, log).select(*ledger.ENTRY))
    current = spark.createDataFrame([("a", 1.2), ("b", 1.0)], "key string, multiplier double")
    for step, want in ((3, 1.1), (4, 1.0)):
        current, said = ledger.rollback(current, log, F.lit(hour(step)))
        assert {r["key"]: r["multiplier"] for r in current.collect()} == {"a": pytest.approx(want), "b": 1.0}
        assert [(r["action"], r["key"], r["status"]) for r in said.collect()] == [("rollback", "a", "rolled_back")]
        log = spark.createDataFrame(log.select(*ledger.ENTRY).unionByName(said.select(*ledger.ENTRY)).collect(), log.select(*ledger.ENTRY).schema)
        current = spark.createDataFrame(current.collect(), current.schema)
    with pytest.raises(Exception, match="no applied change"):
        ledger.rollback(current, log, F.lit(hour(5)))[0].collect()
