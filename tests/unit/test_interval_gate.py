"""Each cause blocks on its own, and nothing blocks a sound record."""

import datetime as dt

import pytest

from tidemark.operators.ledger import STAGES, interval_gate

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 3, 1)
AUDIT = {"status": "ready", "manifest_sha256": "a" * 64, "exact_target_coverage": True, "prospective_period_ready": True, "pipeline_ready": True, "frozen_at": START, "prospective_start": START, "evaluated_at": START + 40 * DAY}
TYPES = "status string, manifest_sha256 string, exact_target_coverage boolean, prospective_period_ready boolean, pipeline_ready boolean, frozen_at timestamp_ntz, prospective_start timestamp_ntz, evaluated_at timestamp_ntz"


def sound():
    origins = [START + k * DAY for k in range(-31, 32)]
    target = lambda at: at + dt.timedelta(hours=2)
    lines = [[at, 2, target(at), stage, "s", "c"] for at in origins for stage in STAGES]
    met = [[at, 2, target(at), 1.0, target(at), target(at)] for at in origins]
    return lines, met


def reasons(spark, lines, met, audit=AUDIT, least=20):
    p = spark.createDataFrame(lines, "origin_at timestamp_ntz, horizon int, target_at timestamp_ntz, stage string, source_identity string, candidate_identity string")
    o = spark.createDataFrame(met, "origin_at timestamp_ntz, horizon int, target_at timestamp_ntz, actual double, actual_at timestamp_ntz, matured_at timestamp_ntz")
    a = spark.createDataFrame([tuple(audit.values())] if audit else [], TYPES)
    return sorted(r["reason"] for r in interval_gate(p, o, a, [2], least).collect())


def test_a_sound_record_passes(spark):
    assert reasons(spark, *sound()) == []


@pytest.mark.parametrize(
    "cause,want",
    [
        ("status", "audit_not_ready"), ("digest", "audit_not_ready"), ("pipeline", "pipeline_not_ready"), ("stage", "incomplete_lineage"), ("identity", "incomplete_lineage"), ("twice", "unpaired_outcomes"),
        ("late", "unpaired_outcomes"), ("actual", "unpaired_outcomes"), ("few", "too_few_pairs"), ("gap", "outside_periods"),
    ],
)
def test_each_cause(spark, cause, want):
    (lines, met), audit, least = sound(), dict(AUDIT), 20
    if cause == "status":
        audit["status"] = "open"
    elif cause == "digest":
        audit["manifest_sha256"] = "a" * 63
    elif cause == "pipeline":
        audit["pipeline_ready"] = None
    elif cause == "stage":
        lines, met = lines + [[START - 33 * DAY, 2, START - 33 * DAY + dt.timedelta(hours=2), "final", "s", "c"]], met
    elif cause == "identity":
        lines += [[START - 33 * DAY, 2, START - 33 * DAY + dt.timedelta(hours=2), s, "s", f"c{k}"] for k, s in enumerate(STAGES)]
    elif cause == "twice":
        met.append(list(met[0]))
    elif cause == "late":
        met[0][4] += DAY
    elif cause == "actual":
        met[0][3] = None
    elif cause == "few":
        least = 32
    elif cause == "gap":
        audit["frozen_at"] = START - DAY / 2
        lines, met = ([r for r in rows if not START - 2 * DAY < r[0] < START] for rows in (lines, met))
        extra = START - DAY / 4
        lines += [[extra, 2, extra + dt.timedelta(hours=2), s, "s", "c"] for s in STAGES]
        met.append([extra, 2, *[extra + dt.timedelta(hours=2)], 1.0, extra + dt.timedelta(hours=2), extra + dt.timedelta(hours=2)])
    assert reasons(spark, lines, met, audit, least) == [want]


def test_nothing_at_all_blocks_on_everything(spark):
    assert reasons(spark, [], [], None) == ["audit_not_ready", "incomplete_lineage", "pipeline_not_ready", "short_prospective_span", "temporal_manifest", "too_few_pairs", "unpaired_outcomes"]
