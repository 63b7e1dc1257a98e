"""All registered queries and their SQL oracles."""

from __future__ import annotations

from tidemark.plans import alignment_queries, base, calibration_queries, candle_queries, drift_queries, ensemble_queries, forecast_queries, monitoring_queries, quality_queries, replay_queries, research_queries, store_queries  # noqa: F401

FLAGSHIP = "performance_summary"


def queries() -> dict[str, base.Query]:
    """Every query of the engine, by name."""
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    """The SQL that gives the same rows, by query name."""
    return dict(base.SQL)
