"""Queries on audits, freshness, contracts, replays and finer features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import candles, evaluate, quality
from tidemark.plans.base import FINE, TYPED, query, r6, table, typed
from tidemark.plans.forecast_queries import NOW, SCORED, now, scored


@query(f"""WITH {SCORED}, a AS (SELECT * FROM scored WHERE horizon <> 16 OR model <> 'drift'), b AS (SELECT origin_at, model, horizon, abs_pct + CASE WHEN model = 'seasonal' THEN 1 ELSE 0 END AS abs_pct FROM scored WHERE horizon <> 2 OR model <> 'blend'),
j AS (SELECT a.origin_at AS ka, b.origin_at AS kb, a.abs_pct AS x, b.abs_pct AS y FROM a FULL JOIN b ON a.origin_at = b.origin_at AND a.model = b.model AND a.horizon = b.horizon)
SELECT 'missing' AS "check", count_if(ka IS NULL)::BIGINT AS rows FROM j UNION ALL SELECT 'unexpected', count_if(kb IS NULL)::BIGINT FROM j
UNION ALL SELECT 'abs_pct_differs', count_if(ka IS NOT NULL AND kb IS NOT NULL AND ((x IS NULL) <> (y IS NULL) OR coalesce(abs(x - y) > 1e-6 * greatest(1, abs(y)), FALSE)))::BIGINT FROM j""")
def history_audit(spark, sf_dir):
    """A stored table against a recomputed one with faults."""
    rows = scored(spark, sf_dir)
    stored = rows.where("horizon <> 16 OR model <> 'drift'")
    other = rows.where("horizon <> 2 OR model <> 'blend'").withColumn("abs_pct", F.col("abs_pct") + F.when(F.col("model") == "seasonal", 1).otherwise(0))
    return quality.history_audit(stored, other, ["series", "origin_at", "model", "horizon"], ["abs_pct"])


@query()
def series_identity(spark, sf_dir):
    return quality.identity(typed(spark, sf_dir), ["ts"], "series")


@query(f"""WITH f AS (SELECT event_type, max(ts) AS newest FROM events GROUP BY 1), a AS (SELECT *, CAST(floor(epoch({NOW})) - floor(epoch(newest)) AS BIGINT) AS age_seconds FROM f)
SELECT event_type, age_seconds, CASE WHEN age_seconds <= 3600 THEN 'fresh' WHEN age_seconds <= 14400 THEN 'late' ELSE 'stale' END AS state FROM a""")
def freshness_check(spark, sf_dir):
    return freshness(table(spark, sf_dir, "events"))


@query()
def freshness_check_whole(spark, sf_dir):
    """freshness_check, under the name that it had over the whole table."""
    return freshness(table(spark, sf_dir, "events"))


def freshness(events):
    out = quality.freshness(events, "ts", now(), 3600, 14400, "event_type")
    return out.select("event_type", "age_seconds", "state")


@query(f"""WITH s AS (SELECT user_id AS source, max(ts) AS seen_at, avg(value) FILTER (event_type = 'view') AS v, avg(value) FILTER (event_type = 'error') AS e FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1), i AS (
SELECT source, CAST((epoch(TIMESTAMP '2024-01-20 00:00:00') - floor(epoch(seen_at))) / 3600 > 12 AS INT) AS a, CAST(e > 55 AS INT) AS b FROM s) SELECT source, a + coalesce(b, 0) > 0 AS quarantined, CAST(a + coalesce(b, 0) AS INT) AS issues FROM i""")
def source_health(spark, sf_dir):
    """Sources that are stale or lack an expected feature."""
    at = F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))
    e = table(spark, sf_dir, "events").where(F.col("ts") < at)
    mean = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    s = e.groupBy(F.col("user_id").alias("source")).agg(F.max("ts").alias("at"), mean("view").alias("v"), mean("error").alias("e"))
    features = F.when(F.col("e") > 55, F.create_map(F.lit("v"), F.lit(1.0))).otherwise(F.create_map(F.lit("v"), F.lit(1.0), F.lit("e"), F.lit(2.0)))
    out = quality.source_health(s.withColumn("features", features), at, 12, ["v", "e"])
    return out.select("source", "quarantined", F.size("issues").alias("issues"))


@query(f"WITH {SCORED} SELECT model, f AS feature, count(*) AS rows, count_if(v IS NULL)::BIGINT AS missing FROM (SELECT model, unnest(['actual', 'predicted', 'abs_pct']) AS f, unnest([actual, predicted, abs_pct]) AS v FROM scored) GROUP BY 1, 2")
def missingness_audit(spark, sf_dir):
    return quality.missingness(scored(spark, sf_dir), ["actual", "predicted", "abs_pct"], "model")


AGES = f"ages AS (SELECT horizon, (epoch({NOW}) - epoch(target_at)) / 3600 AS age, abs_pct FROM scored WHERE actual IS NOT NULL AND model = 'blend'), curve AS (SELECT horizon, CAST(age >= 48 AS INT) + CAST(age >= 168 AS INT) + CAST(age >= 400 AS INT) AS band, count(*) AS samples, avg(abs_pct) AS m FROM ages GROUP BY 1, 2), c2 AS (SELECT horizon, band, samples, CASE WHEN samples >= 20 THEN m END AS m FROM curve)"


def age_rows(spark, sf_dir):
    age = (F.unix_timestamp(now().cast("timestamp")) - F.unix_timestamp(F.col("target_at").cast("timestamp"))) / 3600
    return quality.age_curve(scored(spark, sf_dir).where("actual IS NOT NULL AND model = 'blend'").withColumn("age_hours", age), [48, 168, 400], 20, "horizon")


@query(f"WITH {SCORED}, {AGES} SELECT horizon, band, samples, round(m, 5) AS mean FROM c2")
def value_by_age(spark, sf_dir):
    return age_rows(spark, sf_dir).select("horizon", "band", "samples", F.round("mean", 5).alias("mean"))


@query(f"""WITH {SCORED}, {AGES}, k AS (SELECT *, first_value(m) OVER (PARTITION BY horizon ORDER BY band) AS base FROM c2), o AS (SELECT *, min(CAST(coalesce(m <= base * 1.25, FALSE) AS INT)) OVER (PARTITION BY horizon ORDER BY band) AS ok FROM k)
SELECT horizon, max(CASE WHEN ok = 1 THEN [48.0, 168.0, 400.0, 1e9][band + 1] END)::DOUBLE AS fresh_until FROM o GROUP BY 1""")
def age_thresholds(spark, sf_dir):
    out = quality.age_threshold(age_rows(spark, sf_dir), [48, 168, 400], 0.25, "horizon")
    return out.select("horizon", F.least("fresh_until", F.lit(1e9)).alias("fresh_until"))


@query(f"""WITH {SCORED}, v AS (SELECT unnest(list_filter([CASE WHEN NOT predicted > 0 THEN 'price_not_positive' END, CASE WHEN q10 > q90 THEN 'quantiles_crossed' END, CASE WHEN predicted < q10 OR predicted > q90 THEN 'price_outside' END,
CASE WHEN target_at <= origin_at THEN 'target_not_after_origin' END, CASE WHEN horizon NOT IN (2, 4, 8, 16) THEN 'horizon_unknown' END, CASE WHEN predicted IS NULL THEN 'price_missing' END], lambda x: x IS NOT NULL)) AS violation FROM (SELECT * REPLACE (CASE WHEN model = 'drift' THEN -predicted ELSE predicted END AS predicted, CASE WHEN horizon = 4 THEN 5 ELSE horizon END AS horizon) FROM scored))
SELECT violation, count(*) AS rows FROM v GROUP BY 1""")
def contract_violations(spark, sf_dir):
    """Rules that forecasts with faults break."""
    rows = scored(spark, sf_dir).withColumns({"predicted": F.when(F.col("model") == "drift", -F.col("predicted")).otherwise(F.col("predicted")), "horizon": F.when(F.col("horizon") == 4, 5).otherwise(F.col("horizon"))})
    return quality.contract_violations(rows).select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("rows"))


@query(f"WITH {SCORED} SELECT concat_ws('/', series, strftime(origin_at, '%Y%m%d%H'), model, CAST(horizon AS VARCHAR)) AS id, actual IS NOT NULL AS matured FROM scored")
def forecast_resources(spark, sf_dir):
    return quality.resource(scored(spark, sf_dir)).select("id", F.col("outcome").isNotNull().alias("matured"))


@query("""SELECT event_id, rtrim(translate(to_base64(encode('{"filters":{"type":"' || event_type || '"},"key":' || event_id || '}')), '+/', '-_'), '=') AS cursor, event_id AS back FROM events""")
def opaque_cursors(spark, sf_dir):
    """Cursors and what reading one back gives."""
    return cursors(table(spark, sf_dir, "events"))


@query()
def opaque_cursors_whole(spark, sf_dir):
    """opaque_cursors, under the name that it had over the whole table."""
    return cursors(table(spark, sf_dir, "events"))


def cursors(events):
    out = events.select("event_id", quality.cursor(F.struct(F.col("event_type").alias("type")), F.col("event_id")).alias("cursor"))
    return out.withColumn("back", quality.read_cursor(F.col("cursor"), "filters struct<type: string>, key bigint")["key"])


@query(f"""WITH {FINE}, r AS (SELECT *, ln(close) - ln(lag(close) OVER o) AS ret, row_number() OVER o AS k, ln(1 + volume) AS lv FROM fine WHERE close > 0 WINDOW o AS (PARTITION BY series ORDER BY ts)), f AS (
SELECT series, ts, coalesce(stddev_samp(ret) OVER w * 100, 0) AS volatility, (close / first_value(close) OVER w - 1) * 100 AS momentum, (max(high) OVER w - min(low) OVER w) / close * 100 AS range_pct,
coalesce(covar_pop(k, lv) OVER w / nullif(var_pop(k) OVER w, 0), 0) AS volume_slope FROM r WINDOW w AS (PARTITION BY series ORDER BY ts ROWS 11 PRECEDING))
SELECT series, count(*) AS rows, round(avg(volatility), 4) AS volatility, round(avg(ln(1 + momentum / 100)), 5) AS mean_log_momentum, round(avg(ln(1 + range_pct)), 5) AS mean_log_range, round(avg(volume_slope), 6) AS volume_slope FROM f GROUP BY 1""")
def multi_resolution_features(spark, sf_dir):
    fine = candles.bars(table(spark, sf_dir, "events"), "5 minutes", F.col("event_type"))
    out = quality.fine_features(fine)
    return out.groupBy("series").agg(
        F.count("*").alias("rows"), F.round(F.avg("volatility"), 4).alias("volatility"), F.round(F.avg(F.log1p(F.col("momentum") / 100)), 5).alias("mean_log_momentum"),
        F.round(F.avg(F.log1p("range_pct")), 5).alias("mean_log_range"), F.round(F.avg("volume_slope"), 6).alias("volume_slope"),
    )


@query(f"""WITH {SCORED}, l AS (SELECT origin_at, horizon, count(*) AS n, max(actual) AS a FROM scored WHERE model = 'blend' AND horizon < 16 GROUP BY 1, 2), r AS (SELECT origin_at, horizon, count(*) AS n, max(actual) AS a FROM scored WHERE model = 'seasonal' GROUP BY 1, 2),
j AS (SELECT l.n AS nl, r.n AS nr, l.a AS al, r.a AS ar FROM l FULL JOIN r USING (origin_at, horizon))
SELECT 'duplicate' AS gate, count_if(coalesce(nl, 0) > 1 OR coalesce(nr, 0) > 1)::BIGINT AS rows FROM j UNION ALL SELECT 'missing_partner', count_if(nl IS NULL OR nr IS NULL)::BIGINT FROM j
UNION ALL SELECT 'outcome_mismatch', coalesce(count_if(abs(al - ar) > 1e-9), 0)::BIGINT FROM j UNION ALL SELECT 'paired', count_if(nl IS NOT NULL AND nr IS NOT NULL AND al IS NOT NULL)::BIGINT FROM j""")
def attempt_pairing_gates(spark, sf_dir):
    rows = scored(spark, sf_dir).where("NOT (model = 'blend' AND horizon = 16)")
    return quality.alternatives(rows, "blend", "seasonal", ["series", "origin_at", "horizon"])


@query(f"""WITH {SCORED}, w AS (SELECT horizon, count(abs_pct) FILTER (regime = 'range') AS na, avg(abs_pct) FILTER (regime = 'range') AS ma, var_samp(abs_pct) FILTER (regime = 'range') AS va, count(abs_pct) FILTER (regime = 'trending') AS nb, avg(abs_pct) FILTER (regime = 'trending') AS mb, var_samp(abs_pct) FILTER (regime = 'trending') AS vb FROM scored WHERE model = 'blend' GROUP BY 1)
SELECT horizon, na AS n_a, nb AS n_b, round((ma - mb) / nullif(sqrt(va / na + vb / nb), 0), 5) AS z FROM w""")
def segment_two_sample(spark, sf_dir):
    """Whether errors differ between two regimes."""
    out = quality.two_sample(scored(spark, sf_dir).where("model = 'blend'"), "abs_pct", "regime", "range", "trending", "horizon")
    return out.select("horizon", "n_a", "n_b", F.round("z", 5).alias("z"))


@query()
def segment_p_values(spark, sf_dir):
    out = quality.two_sample(scored(spark, sf_dir).where("model = 'blend'"), "abs_pct", "regime", "range", "trending", "horizon")
    return out.select("horizon", r6(quality.two_sided_p("z")).alias("p"))


@query()
def stacked_weights(spark, sf_dir):
    out = quality.stacked_weights(scored(spark, sf_dir), ["persistence", "drift", "momentum", "seasonal"], "horizon")
    return out.select("horizon", "model", r6("weight").alias("weight"))


CONFIGURATIONS = [(f"d{d}_f{f}", float(d), f) for d in (0, 1, 4) for f in (0.0, 0.05, 0.2)]
CONFIG_SQL = "cfg(configuration, decay, floor_) AS (VALUES " + ", ".join(f"('{n}', {d}::DOUBLE, {f}::DOUBLE)" for n, d, f in CONFIGURATIONS) + ")"


@query(f"""WITH {SCORED}, {CONFIG_SQL}, k AS (SELECT *, avg(abs_pct) OVER (PARTITION BY model, horizon ORDER BY origin_at ROWS BETWEEN 64 PRECEDING AND 17 PRECEDING) AS past FROM scored WHERE actual IS NOT NULL AND predicted > 0), d AS (
SELECT configuration, origin_at, horizon, actual, predicted, greatest(exp(-decay * past / 100), floor_) AS w FROM k, cfg WHERE past IS NOT NULL), b AS (SELECT configuration, origin_at, horizon, exp(sum(w * ln(predicted)) / sum(w)) AS price, max(actual) AS actual FROM d GROUP BY 1, 2, 3)
SELECT configuration, horizon, count(*) AS origins, round(avg(abs(price - actual) / nullif(actual, 0) * 100), 4) AS mae_pct FROM b GROUP BY 1, 2""")
def candidate_replay(spark, sf_dir):
    """Nine weighting configurations at every origin, on matured errors only."""
    grid = spark.createDataFrame(CONFIGURATIONS, "configuration string, decay double, floor double")
    return quality.replay(scored(spark, sf_dir), grid, 48, "horizon").select("configuration", "horizon", "origins", F.round("mae_pct", 4).alias("mae_pct"))
