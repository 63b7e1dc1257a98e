"""Queries on providers, alerts and assertions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import candles, monitoring
from tidemark.plans.base import NOW, THINNED, TYPED, query, r6, table, thinned, typed
from tidemark.plans.candle_queries import DECIDED, FEATURES, GAPS, NAMES, OVERLAP, now, regimes
from tidemark.plans.forecast_queries import SCORED, scored

REPORT = f"""{THINNED}, {TYPED}, {GAPS}, {OVERLAP}, {DECIDED}, every_ AS (SELECT series FROM thinned UNION SELECT series FROM typed),
gg AS (SELECT series, count(*) AS gaps_detected, CAST(sum(missing) AS BIGINT) AS missing_candles_total FROM gaps GROUP BY 1),
sg AS (SELECT series, count(*) AS secondary_gaps FROM (SELECT series, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series ORDER BY ts)) AS step FROM typed) WHERE step > 3600 GROUP BY 1),
ed AS (SELECT series, min(ts) AS low, max(ts) AS high FROM thinned GROUP BY 1),
sf AS (SELECT t.series, count(*) AS silent FROM typed t JOIN ed USING (series) WHERE t.ts > ed.low AND t.ts < ed.high AND NOT EXISTS (SELECT 1 FROM thinned x WHERE x.series = t.series AND x.ts = t.ts) GROUP BY 1),
dg AS (SELECT series, count_if(action = 'fill') AS f, count_if(action = 'degrade') AS g, count_if(action = 'withhold') AS w, sum(CASE WHEN action = 'fill' THEN missing ELSE 0 END) AS n FROM decided GROUP BY 1),
report_ AS (SELECT e.series, CAST(coalesce(common, 0) AS BIGINT) AS overlapping, CAST(coalesce(divergent, 0) AS BIGINT) AS divergent, coalesce(status, 'insufficient') AS overlap_status,
  coalesce(gaps_detected, 0) AS gaps_detected, coalesce(missing_candles_total, 0) AS missing_candles_total, coalesce(secondary_gaps, 0) AS secondary_gaps, coalesce(silent, 0) AS silent_fill_candidates,
  CAST(coalesce(f, 0) AS BIGINT) AS fill_gaps, CAST(coalesce(g, 0) AS BIGINT) AS degrade_gaps, CAST(coalesce(w, 0) AS BIGINT) AS withhold_gaps, CAST(coalesce(n, 0) AS BIGINT) AS filled_candles,
  CASE WHEN w > 0 THEN 'withhold' WHEN g > 0 THEN 'degrade' WHEN f > 0 THEN 'fill' ELSE 'none' END AS policy_action
  FROM every_ e LEFT JOIN agreed USING (series) LEFT JOIN gg USING (series) LEFT JOIN sg USING (series) LEFT JOIN sf USING (series) LEFT JOIN dg USING (series))"""
LIMITS = {"gaps_detected": (3, 60), "missing_candles_total": (6, 200), "silent_fill_candidates": (1, 150), "withhold_gaps": (0, 3)}
ALERTS = f"""{REPORT}, limits(metric, warn, critical) AS (VALUES {', '.join(f"('{m}', {w}, {c})" for m, (w, c) in LIMITS.items())}),
long_ AS (SELECT series, metric, value, warn, critical FROM (SELECT series, {', '.join(LIMITS)} FROM report_) UNPIVOT (value FOR metric IN ({', '.join(LIMITS)})) JOIN limits USING (metric)),
fired AS (SELECT series, metric, value, CASE WHEN value >= critical THEN 'critical' ELSE 'warning' END AS level, CAST(CASE WHEN value >= critical THEN critical ELSE warn END AS BIGINT) AS threshold
  FROM long_ WHERE value >= critical OR (warn > 0 AND value >= warn)),
alerts AS (SELECT * FROM fired UNION ALL SELECT series, 'forecast_withheld', greatest(withhold_gaps, 1), 'critical', {LIMITS["withhold_gaps"][1]} FROM report_
  WHERE (policy_action = 'withhold' OR withhold_gaps > 0) AND series NOT IN (SELECT series FROM fired WHERE metric = 'withhold_gaps'))"""


def report(spark, sf_dir):
    return monitoring.reconciliation(thinned(spark, sf_dir), typed(spark, sf_dir))


@query(f"WITH {REPORT} SELECT * FROM report_")
def reconciliation_report(spark, sf_dir):
    """Counts of what two providers have, differ in and lack, by series."""
    return report(spark, sf_dir)


@query(f"WITH {ALERTS} SELECT * FROM alerts")
def gap_alerts(spark, sf_dir):
    """Metrics of the report that reach a threshold, and forecasts that the policy withholds without one."""
    return monitoring.threshold_alerts(report(spark, sf_dir), LIMITS, "series", F.col("policy_action") == "withhold")


@query(f"""WITH {ALERTS} SELECT series, CASE WHEN bool_or(level = 'critical') THEN 'critical' WHEN count(level) > 0 THEN 'warning' ELSE 'ok' END AS level, count(level) AS alerts
FROM report_ LEFT JOIN alerts USING (series) GROUP BY 1""")
def gap_alert_levels(spark, sf_dir):
    rows = report(spark, sf_dir)
    return monitoring.overall_level(monitoring.threshold_alerts(rows, LIMITS, "series", F.col("policy_action") == "withhold"), "series", rows)


UNWELL = ("missing_interval", "non_positive_price")
BAD = """(SELECT series, bool_or(step > 3600 OR least(open, high, low, close) <= 0) AS bad FROM (
  SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series ORDER BY ts)) AS step FROM {t}) GROUP BY 1)"""


@query(f"""WITH {THINNED}, {TYPED}, {OVERLAP}, p AS {BAD.format(t="thinned")}, s AS {BAD.format(t="typed")}, q AS (
SELECT series, CASE WHEN p.series IS NOT NULL AND s.series IS NOT NULL AND status = 'divergent' THEN 'providers_disagree' WHEN NOT p.bad THEN 'primary_healthy'
  WHEN NOT s.bad AND p.series IS NULL THEN 'primary_outage' WHEN NOT s.bad AND status = 'agree' THEN 'failover'
  WHEN NOT s.bad THEN 'failover_without_agreement' ELSE 'none_healthy' END AS reason FROM p FULL JOIN s USING (series) LEFT JOIN agreed USING (series))
SELECT series, reason, CASE reason WHEN 'primary_healthy' THEN 'primary' WHEN 'failover' THEN 'secondary' WHEN 'primary_outage' THEN 'secondary' END AS source FROM q""")
def provider_selection(spark, sf_dir):
    """Which provider each series is read from, and why."""
    return monitoring.selected_source(thinned(spark, sf_dir), typed(spark, sf_dir), list(UNWELL), now())


@query("""WITH s AS (SELECT event_id, user_id, ts AS origin_at FROM events WHERE event_type = 'signup'), n AS (SELECT user_id, min(ts) FILTER (event_type = 'view') AS first_view, min(ts) AS first_seen FROM events GROUP BY 1)
SELECT event_id, CAST(coalesce(first_view > origin_at, TRUE) AS INT) AS late_views FROM s JOIN n USING (user_id) WHERE coalesce(first_view > origin_at, TRUE) OR coalesce(first_seen > origin_at, TRUE)""")
def lookahead_violations(spark, sf_dir):
    """Signups whose features need a view that comes later or never."""
    e = table(spark, sf_dir, "events")
    known = e.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "view", F.col("ts"))).alias("first_view"), F.min("ts").alias("first_seen"))
    rows = e.where("event_type = 'signup'").select("event_id", "user_id", F.col("ts").alias("origin_at")).join(known, "user_id")
    late = monitoring.lookahead_violations(rows, "origin_at", ["first_view", "first_seen"])
    return late.select("event_id", F.array_contains("late", "first_view").cast("int").alias("late_views"))


@query("""WITH a AS (SELECT user_id, ts FROM events WHERE event_type = 'click'), b AS (SELECT user_id, ts FROM events WHERE event_type IN ('click', 'error') AND value > 1)
SELECT side, count(*) AS origins FROM (SELECT 'one' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'other', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY 1""")
def origins_apart(spark, sf_dir):
    """Origins that only one of two runs has."""
    e = table(spark, sf_dir, "events")
    out = monitoring.origins_apart(e.where("event_type = 'click'"), e.where("event_type IN ('click', 'error') AND value > 1"), ["user_id", "ts"])
    return out.groupBy("side").agg(F.count("*").alias("origins"))


EXPLORED = f"{SCORED}, ex AS (SELECT *, CASE WHEN actual IS NULL THEN 'pending' ELSE 'matured' END AS status FROM scored WHERE model = 'blend')"


@query(f"""WITH {EXPLORED} SELECT origin_at, regime, round(abs_pct, 5) AS abs_pct, CAST(row_number() OVER (ORDER BY abs_pct ASC NULLS LAST, origin_at) AS INT) AS place FROM ex
WHERE horizon = 8 AND origin_at >= {NOW} - INTERVAL 14 DAY AND contains(lower(strftime(origin_at, '%Y-%m-%d %H:%M:%S') || ' ' || regime || ' ' || status || ' ' || horizon), 'range')
QUALIFY place <= 100""")
def explorer_page(spark, sf_dir):
    """A page of a hundred rows with the least errors, of one horizon and two weeks, that mention a word."""
    rows = scored(spark, sf_dir).where("model = 'blend'").withColumn("status", F.when(F.col("actual").isNull(), "pending").otherwise("matured"))
    since = now() - F.make_dt_interval(F.lit(14))
    page = monitoring.explorer(rows, 8, since, "Range", "error").orderBy(F.asc_nulls_last("abs_pct"), "origin_at").limit(100)
    key = F.struct(F.col("abs_pct").isNull().alias("unknown"), "abs_pct", "origin_at", "regime")
    listed = page.agg(F.array_sort(F.collect_list(key)).alias("rows"))  # a hundred at most
    return listed.select(F.posexplode("rows")).select("col.origin_at", "col.regime", F.round("col.abs_pct", 5).alias("abs_pct"), (F.col("pos") + 1).alias("place"))


@query(f"""WITH {SCORED} SELECT model, origin_at, round(avg(abs_pct) OVER w, 5) AS rolling, count(abs_pct) OVER w AS known FROM scored WHERE horizon = 8
WINDOW w AS (PARTITION BY model ORDER BY origin_at ROWS 23 PRECEDING)""")
def rolling_chart(spark, sf_dir):
    """Rolling means of known errors, with how many they are of."""
    out = monitoring.rolling_metrics(scored(spark, sf_dir).where("horizon = 8"), "abs_pct", 24, "series", "model")
    return out.select("model", "origin_at", F.round("rolling", 5).alias("rolling"), "known")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS k FROM events), s AS (
SELECT event_type, count(*) AS requests, list_sort(list(value)) AS v FROM r WHERE k <= 1000 GROUP BY 1) SELECT event_type, requests, round(v[greatest(CAST(floor(len(v) * 0.95) AS INT), 1)], 6) AS p95 FROM s""")
def latency_p95(spark, sf_dir):
    """The 95th percentile of the newest thousand values of each type."""
    out = monitoring.latency_p95(table(spark, sf_dir, "events"), "value", "ts", 1000, "event_type")
    return out.select("event_type", "requests", r6("p95").alias("p95"))


@query(f"""WITH {TYPED}, {THINNED}, a AS (SELECT series, ts FROM typed), e AS (SELECT a.*, x.ts AS seen, x.close, x.volume FROM a ASOF LEFT JOIN thinned x ON a.series = x.series AND a.ts >= x.ts), q AS (
SELECT *, CASE WHEN seen IS NULL THEN 'unavailable' WHEN epoch(ts) - epoch(seen) > 2 * 3600 THEN 'stale' WHEN close IS NULL OR volume IS NULL THEN 'partial' ELSE 'ok' END AS quality FROM e)
SELECT series, quality, count(*) AS origins, count(CASE WHEN quality IN ('ok', 'partial') THEN close END) AS usable FROM q GROUP BY 1, 2""")
def degraded_snapshots(spark, sf_dir):
    """Origins whose second source is there, too old or missing: a status instead of a failure."""
    from tidemark.operators import pit

    origins = typed(spark, sf_dir).select("series", "ts")
    found = pit.as_of(origins, thinned(spark, sf_dir), "series", "ts", F.struct("close", "volume"))
    source = found.where("found IS NOT NULL").select("series", "ts", F.col("found.at").alias("seen"), "found.value.close", "found.value.volume")
    age = (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("seen").cast("timestamp"))) / 3600
    out = monitoring.degraded(origins, source, ["series", "ts"], ["close", "volume"], age, 2)
    return out.groupBy("series", "quality").agg(F.count("*").alias("origins"), F.count("close").alias("usable"))


@query(f"""WITH {FEATURES} SELECT ts, round(coalesce(CASE WHEN volatility_6h > 0 AND isfinite(volatility_6h) THEN volatility_6h END, CASE WHEN volatility_24h > 0 AND isfinite(volatility_24h) THEN volatility_24h END,
CASE WHEN volatility_168h > 0 AND isfinite(volatility_168h) THEN volatility_168h END), 5) AS volatility FROM feats""")
def origin_volatility(spark, sf_dir):
    """The first usable of three volatilities."""
    return regimes(spark, sf_dir).select("ts", F.round(monitoring.first_positive(*[F.col(f"volatility_{k}h") for k in (6, 24, 168)]), 5).alias("volatility"))


GROUPS = {"volatility": ["volatility_"], "trend": ["momentum_", "rsi_"]}


@query(f"""WITH n(name) AS (VALUES {', '.join(f"('{n}')" for n in NAMES)}), g AS (SELECT name, CASE WHEN starts_with(name, 'volatility_') THEN 'volatility' WHEN starts_with(name, 'momentum_') OR starts_with(name, 'rsi_') THEN 'trend' ELSE 'engine' END AS grp FROM n)
SELECT grp AS feature_group, string_agg(name, ',' ORDER BY name) AS names FROM g GROUP BY 1""")
def feature_groups(spark, sf_dir):
    """Names of the market features by group."""
    features = F.create_map(*[x for n in NAMES for x in (F.lit(n), F.lit(0.0))])
    groups = spark.range(1).select(F.explode(monitoring.feature_groups(features, GROUPS, "engine")).alias("feature_group", "names"))
    return groups.select("feature_group", F.array_join("names", ",").alias("names"))
