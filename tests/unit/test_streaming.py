import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import candles
from tidemark.sources import readers, writers
from tidemark.streaming import operators as streaming

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.sql(f"SELECT * FROM {name}").collect()


def stream(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_rate_limit(spark, tmp_path):
    rows = [("a", at(s)) for s in (0, 1, 2, 3, 11, 12)] + [("b", at(0))]
    out = drain(spark, streaming.rate_limited(stream(spark, rows, "identity string, at timestamp", str(tmp_path / "r")), 2, 10), "limits")
    got = [(r["identity"], r["allowed"]) for r in sorted(out, key=lambda r: (r["identity"], r["at"]))]
    assert got == [("a", True), ("a", True), ("a", False), ("a", False), ("a", True), ("a", True), ("b", True)]


def test_circuit(spark, tmp_path):
    rows = [("s", at(t), ok) for t, ok in ((0, False), (1, False), (2, True), (3, False), (4, False), (5, False), (6, True), (70, True))]
    out = drain(spark, streaming.circuit_states(stream(spark, rows, "stage string, at timestamp, ok boolean", str(tmp_path / "c")), 3, 60), "circuits")
    assert [r["circuit"] for r in sorted(out, key=lambda r: r["at"])] == ["closed"] * 5 + ["open", "open", "closed"]


def test_alerts(spark, tmp_path):
    rows = [("m", "warning", at(s)) for s in (0, 10, 59, 60, 200)] + [("m", "critical", at(1))]
    out = drain(spark, streaming.deduplicated_alerts(stream(spark, rows, "metric string, severity string, at timestamp", str(tmp_path / "a")), 60), "alerts")
    assert sorted((r["severity"], r["at"].second, r["at"].minute) for r in out) == [("critical", 1, 0), ("warning", 0, 0), ("warning", 0, 1), ("warning", 20, 3)]


def test_bars_equal_batch(spark, tmp_path):
    rows = [(k, "x", at(k * 700), float(k % 7)) for k in range(40)]
    schema = "event_id long, series string, ts timestamp, value double"
    out = drain(spark, streaming.streaming_bars(stream(spark, rows, schema, str(tmp_path / "b")), "1 hour", "10 minutes"), "bars")
    batch = candles.bars(spark.createDataFrame(rows, schema), series=F.col("series")).collect()
    assert {tuple(r) for r in out} <= {tuple(r) for r in batch} and len(out) >= len(batch) - 1


def test_maturation(spark, tmp_path):
    f = stream(spark, [("s", "m", at(3600 * k)) for k in range(5)], "series string, model string, target_at timestamp", str(tmp_path / "f"))
    c = stream(spark, [("s", at(3600 * k), float(k)) for k in (1, 3, 9)], "series string, ts timestamp, close double", str(tmp_path / "m"))
    out = drain(spark, streaming.streaming_maturation(f, c, "1 hour"), "matured")
    assert sorted(r["actual"] for r in out) == [1.0, 3.0]


def test_appending_is_idempotent(spark, tmp_path):
    schema = "k long, v double"
    path = str(tmp_path / "table")
    for turn in range(2):
        rows = stream(spark, [(k, float(k + turn)) for k in range(5 + turn)], schema, str(tmp_path / f"in{turn}"))
        streaming.append_batches(rows, path, ["k"], [F.col("v")], str(tmp_path / f"ck{turn}")).awaitTermination(120)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(k, float(k)) for k in range(5)] + [(5, 6.0)]


def test_readers(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("ts,open,high,low,close,volume\n2024-01-01 01:00:00,1,2,0.5,1.5,9\nbad,1,2,3,x,1\n")
    out = candles.audit_rows(readers.read_raw_csv(spark, str(tmp_path / "raw.csv"))).collect()
    assert [sorted(r["reasons"]) for r in out] == [[], ["close_unparsable", "high_below_low", "ts_unparsable"]]
    (tmp_path / "macro.csv").write_text("observation_date,VIX\n2024-01-01,10\n2024-01-02,.\n2024-01-03,12\n")
    days = readers.read_macro_csv(spark, str(tmp_path / "macro.csv"), "VIX")
    origins = spark.createDataFrame([(d,) for d in ("2024-01-01 12:00:00", "2024-01-02 00:00:00", "2024-01-04 01:00:00")], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
    assert [None if r["found"] is None else r["found"]["value"] for r in readers.eligible_macro(days, origins, "ts").orderBy("ts").collect()] == [None, 10.0, 12.0]
    (tmp_path / "e.jsonl").write_text('{"domain":"a","status":"ok","timestamp":"2024-01-01T00:00:00Z"}\nnot json\n{"domain":"b","status":"x","timestamp":"never"}\n')
    assert [r["domain"] for r in readers.read_event_lines(spark, str(tmp_path / "e.jsonl")).collect()] == ["a"]
    (tmp_path / "doc.json").write_text('{"series":"s","hourly":{"ts":[3600,7200],"open":[1,2],"high":[1,2],"low":[1,2],"close":[1,2],"volume":[1,2]}}')
    assert [r["close"] for r in readers.read_candle_document(spark, str(tmp_path / "doc.json"), "hourly").orderBy("ts").collect()] == [1.0, 2.0]
    (tmp_path / "act.json").write_text('{"3600": 1.5, "x": 2}')
    assert [r["price"] for r in readers.read_actuals(spark, str(tmp_path / "act.json")).collect()] == [1.5]


def test_writers(spark, tmp_path):
    rows = spark.range(25).select("id", (F.col("id") * 7 % 25).alias("k"))
    paged = writers.pages(rows.repartition(3), [F.col("k")], 10).collect()
    assert sorted((r["k"], r["rank"], r["page"]) for r in paged) == [(k, k, k // 10) for k in range(25)]
    writers.export(rows, str(tmp_path / "x"), "jsonl", [F.col("id")])
    with pytest.raises(ValueError):
        writers.export(rows, str(tmp_path / "y"), "xml", [F.col("id")])
    manifest = writers.archive(rows, str(tmp_path / "z")).collect()
    assert sum(r["rows"] for r in manifest) == 25 and all(len(r["sha256"]) == 64 for r in manifest)
