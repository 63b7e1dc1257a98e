"""Structured Streaming: maturation, bars with late data, limits, breakers and alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streaming_bars(events: DataFrame, every: str, late: str, ts: str = "ts", value: str = "value", event: str = "event_id") -> DataFrame:
    """Bars of tumbling windows that close when no event more than `late` behind may come."""
    order = F.struct(ts, event)
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, every), "series")
    out = grouped.agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").alias("volume"))
    return out.select("series", F.col("window.end").alias("ts"), "open", "high", "low", "close", "volume")


def streaming_maturation(forecasts: DataFrame, candles: DataFrame, late: str) -> DataFrame:
    """Forecasts joined with their exact target candles as these arrive.

    Both sides carry watermarks and the join bounds the candle's time by the
    target's, so that the state of either side is dropped once it can't match.
    """
    left = forecasts.withWatermark("target_at", late).alias("f")
    right = candles.withWatermark("ts", late).alias("c")
    on = (F.col("f.series") == F.col("c.series")) & (F.col("f.target_at") == F.col("c.ts"))
    return left.join(right, on).select("f.*", F.col("c.close").alias("actual"))


def rate_limited(requests: DataFrame, limit: int, window_seconds: float) -> DataFrame:
    """Requests (identity, at) with allowed and retry_after by a sliding window of each identity.

    State is at most `limit` times of an identity, dropped a window after its
    last request. Refused requests don't count.
    """

    def allow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        out = []
        for at in rows["at"]:
            now = at.timestamp()
            times = [t for t in times if t > now - window_seconds]
            good = len(times) < limit
            if good:
                times.append(now)
            out.append((key[0], at, good, 0.0 if good else times[0] + window_seconds - now))
        state.update((times,))
        state.setTimeoutDuration(int(window_seconds * 1000))
        yield pd.DataFrame(out, columns=["identity", "at", "allowed", "retry_after"])

    return requests.groupBy("identity").applyInPandasWithState(
        allow, "identity string, at timestamp, allowed boolean, retry_after double", "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def circuit_states(outcomes: DataFrame, failures: int, cooldown_seconds: float) -> DataFrame:
    """Outcomes (stage, at, ok) with the circuit's state after each: closed, open, or half_open on the first try after the cooldown."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, opened = state.get if state.exists else (0, None)
        out = []
        for row in pd.concat(list(batches)).sort_values("at", kind="stable").itertuples():
            now = row.at.timestamp()
            trying = opened is not None and now >= opened + cooldown_seconds
            if row.ok and (opened is None or trying):
                count, opened = 0, None
            elif not row.ok:
                count += 1
                if count >= failures or trying:
                    opened = now
            out.append((key[0], row.at, count, "closed" if opened is None else "half_open" if now >= opened + cooldown_seconds else "open"))
        state.update((count, opened))
        yield pd.DataFrame(out, columns=["stage", "at", "failures", "circuit"])

    return outcomes.groupBy("stage").applyInPandasWithState(
        follow, "stage string, at timestamp, failures long, circuit string", "failures long, opened double", "append", GroupStateTimeout.NoTimeout
    )


def deduplicated_alerts(alerts: DataFrame, cooldown_seconds: float) -> DataFrame:
    """Alerts (metric, severity, at) that weren't raised within the cooldown before."""

    def fire(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for at in pd.concat(list(batches))["at"].sort_values():
            if last is None or at.timestamp() - last >= cooldown_seconds:
                last = at.timestamp()
                out.append((*key, at))
        state.update((last,))
        yield pd.DataFrame(out, columns=["metric", "severity", "at"])

    return alerts.groupBy("metric", "severity").applyInPandasWithState(fire, "metric string, severity string, at timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def append_batches(rows: DataFrame, path: str, key: list[str], order: list, checkpoint: str):
    """A stream appended to a table with first-write-wins, batch by batch; a replayed batch adds nothing."""
    from tidemark.sources.writers import append_first

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: append_first(batch, path, key, order)).trigger(availableNow=True).start()
