"""Baseline forecasts for every origin at once, their outcomes and their scores.

Forecasts are rows (series, origin_at, model, horizon, target_at, source_price,
predicted, q10, q90); scoring adds the outcome where the exact target candle is
there. Nothing reads a candle after its origin.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions import scalars
from tidemark.operators.features import log_returns

HORIZONS = (2, 4, 8, 16)
Z90 = 1.2815515655446004


def hours(n):
    return F.make_dt_interval(F.lit(0), n)


def baselines(candles: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """persistence, drift, momentum, seasonal and their blend at every origin with a full day behind it.

    drift and momentum go on with the mean return of 168 and 24 hours, within
    two deviations; seasonal repeats the price of a day before the target; the
    blend is the geometric mean of the first three.
    """
    order = W.partitionBy("series").orderBy("ts")
    frame = lambda n: order.rowsBetween(-(n - 1), 0)
    sd = F.greatest(F.coalesce(F.stddev_pop("ret").over(frame(168)), F.lit(0.0)), F.lit(1e-6))
    found = log_returns(candles).withColumns({"seen": F.row_number().over(order), "sd": sd, "m168": F.avg("ret").over(frame(168)), "m24": F.avg("ret").over(frame(24))})
    bounded = lambda c: F.greatest(F.least(F.col(c), 2 * F.col("sd")), -2 * F.col("sd"))
    found = found.withColumns({"drift": bounded("m168"), "momentum": bounded("m24"), **{f"day{h}": F.lag("close", 24 - h).over(order) for h in horizons}})
    found = found.where((F.col("seen") > 24) & (F.col("close") > 0))
    rows = []
    for h in horizons:
        price = {
            "persistence": F.col("close"),
            "drift": F.col("close") * F.exp(F.col("drift") * h),
            "momentum": F.col("close") * F.exp(F.col("momentum") * h),
            "seasonal": F.col(f"day{h}"),
            "blend": F.col("close") * F.exp((F.col("drift") + F.col("momentum")) * h / 3),
        }
        rows += [F.struct(F.lit(m).alias("model"), F.lit(h).alias("horizon"), p.alias("predicted"), (F.col("sd") * float(np.sqrt(h))).alias("spread")) for m, p in price.items()]
    long = found.select("series", F.col("ts").alias("origin_at"), F.col("close").alias("source_price"), F.inline(F.array(*rows)))
    return long.select(
        "series", "origin_at", "model", "horizon", (F.col("origin_at") + hours(F.col("horizon"))).alias("target_at"), "source_price", "predicted",
        (F.col("predicted") * F.exp(-Z90 * F.col("spread"))).alias("q10"), (F.col("predicted") * F.exp(Z90 * F.col("spread"))).alias("q90"),
    )


def scored(forecasts: DataFrame, candles: DataFrame, epsilon: float = 0.005) -> DataFrame:
    """forecasts with actual and, where it is known, errors, changes, direction and interval hits."""
    outcome = candles.select("series", F.col("ts").alias("target_at"), F.col("close").alias("actual"))
    both = forecasts.join(outcome, ["series", "target_at"], "left")
    moved = lambda c: scalars.direction(F.col(c) - F.col("source_price"), epsilon)
    return both.withColumns(
        {
            "abs_pct": scalars.abs_error_pct(F.col("predicted"), F.col("actual")),
            "signed_pct": scalars.signed_error_pct(F.col("predicted"), F.col("actual")),
            "actual_change_pct": scalars.pct_change(F.col("actual"), F.col("source_price")),
            "predicted_change_pct": scalars.pct_change(F.col("predicted"), F.col("source_price")),
            "direction_correct": (moved("predicted") == moved("actual")).cast("int"),
            "within": scalars.within(F.col("actual"), F.col("q10"), F.col("q90")),
        }
    )


def ema_forecast(candles: DataFrame, window: int = 168, span: int = 24) -> DataFrame:
    """(series, ts, ema): the exponential mean of the last `window` returns, oldest first, with alpha 2 / (span + 1)."""
    alpha = 2 / (span + 1)
    frame = W.partitionBy("series").orderBy("ts").rowsBetween(-(window - 1), 0)
    returns = F.collect_list("ret").over(frame)
    ema = F.aggregate(F.slice(returns, 2, window), F.try_element_at(returns, F.lit(1)), lambda acc, r: alpha * r + (1 - alpha) * acc)
    return log_returns(candles).select("series", "ts", ema.alias("ema"))


def ar1_paths(candles: DataFrame, window: int = 168, steps: int = 16) -> DataFrame:
    """(series, ts, phi, path): the returns of the next steps by a first-order autoregression.

    phi is the covariance of neighbouring returns over the variance of the
    earlier ones, within 0.95; each step is within four deviations.
    """
    order = W.partitionBy("series").orderBy("ts")
    frame = order.rowsBetween(-(window - 1), 0)
    moved = log_returns(candles).withColumn("before", F.lag("ret").over(order)).where("before IS NOT NULL")
    variance = F.nullif(F.var_pop("before").over(frame), F.lit(0.0))
    found = moved.withColumns({"phi": F.covar_pop("ret", "before").over(frame) / variance, "mean": F.avg("ret").over(frame), "sd": F.greatest(F.stddev_pop("ret").over(frame), F.lit(1e-6))})
    found = found.withColumn("phi", F.coalesce(F.greatest(F.least("phi", F.lit(0.95)), F.lit(-0.95)), F.lit(0.0)))
    step = lambda last: F.greatest(F.least(F.col("mean") + F.col("phi") * (last - F.col("mean")), 4 * F.col("sd")), -4 * F.col("sd"))
    path = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), F.struct(F.col("ret").alias("last"), F.array().cast("array<double>").alias("path")),
        lambda acc, _: F.struct(step(acc["last"]).alias("last"), F.concat(acc["path"], F.array(step(acc["last"]))).alias("path")), lambda acc: acc["path"],
    )
    return found.select("series", "ts", "phi", path.alias("path"))


def training_rows(features: DataFrame, names: list[str], horizon: int) -> DataFrame:
    """(series, ts, x, y): finite features of each origin and the log return to its exact target."""
    target = features.select("series", (F.col("ts") - hours(F.lit(horizon))).alias("ts"), F.col("close").alias("later"))
    good = [F.col(n).isNotNull() & ~F.isnan(n) for n in names]
    usable = features.where((F.col("close") > 0) & F.forall(F.array(*good), lambda g: g))
    return usable.join(target, ["series", "ts"]).where("later > 0").select("series", "ts", F.array(*names).alias("x"), F.log(F.col("later") / F.col("close")).alias("y"))


def _fit(x: np.ndarray, y: np.ndarray, method: str) -> tuple:
    mean, sd = x.mean(axis=0), np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1)
    z = (x - mean) / sd
    if method == "ridge":
        w = np.linalg.solve(z.T @ z + 10.0 * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    else:
        w, alpha, share = np.zeros(z.shape[1]), 1e-3, 0.6
        rest, n = y - y.mean(), len(y)
        for _ in range(200):
            moved = 0.0
            for k in range(len(w)):
                rho = z[:, k] @ (rest + z[:, k] * w[k]) / n
                new = np.sign(rho) * max(abs(rho) - alpha * share, 0) / ((z[:, k] ** 2).mean() + alpha * (1 - share))
                rest = rest + z[:, k] * (w[k] - new)
                moved, w[k] = max(moved, abs(new - w[k])), new
            if moved < 1e-8:
                break
    return mean, sd, w, y.mean()


def walk_forward_linear(rows: DataFrame, horizon: int, method: str = "ridge", least: int = 200, every: int = 24) -> DataFrame:
    """(series, ts, prediction, y) of linear models refitted every so many origins on matured rows only.

    Each series is one group of an applyInPandas: its candles, not the table's,
    must fit a task, as a fit needs them together.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ts", kind="stable").reset_index(drop=True)
        x, y = np.array(part["x"].tolist(), float), part["y"].to_numpy(float)
        at = part["ts"].to_numpy("datetime64[s]")
        out, model = np.full(len(part), np.nan), None
        for k in range(len(part)):
            if model is None or k % every == 0:
                seen = at + np.timedelta64(horizon, "h") <= at[k]
                model = _fit(x[seen], y[seen], method) if seen.sum() >= least else None
            if model is not None:
                mean, sd, w, b = model
                out[k] = (x[k] - mean) / sd @ w + b
        return pd.DataFrame({"series": part["series"], "ts": part["ts"], "prediction": out, "y": y}).dropna()

    return rows.groupBy("series").applyInPandas(run, "series string, ts timestamp_ntz, prediction double, y double")


def boosted_trees(rows: DataFrame, trees: int = 40, rate: float = 0.05, leaf: int = 8) -> DataFrame:
    """(series, ts, prediction, y) of depth-two boosted trees, fitted on the first half of each series and applied to the rest."""

    def best(x: np.ndarray, y: np.ndarray) -> tuple[int, float] | None:
        found = None
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            s, n = np.cumsum(y[order]), np.arange(1, len(y) + 1)
            gain = s[:-1] ** 2 / n[:-1] + (s[-1] - s[:-1]) ** 2 / (len(y) - n[:-1])
            here = x[order, k]
            ok = (here[1:] > here[:-1]) & (n[:-1] >= leaf) & (len(y) - n[:-1] >= leaf)
            if ok.any():
                j = int(np.where(ok, gain, -np.inf).argmax())
                if found is None or gain[j] > found[2]:
                    found = (k, float((here[j] + here[j + 1]) / 2), float(gain[j]))
        return found and found[:2]

    def grow(x: np.ndarray, y: np.ndarray, depth: int):
        cut = best(x, y) if depth and len(y) >= 2 * leaf else None
        if cut is None:
            return float(y.mean()) if len(y) else 0.0
        left = x[:, cut[0]] <= cut[1]
        return (*cut, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))

    def apply(node, x: np.ndarray) -> np.ndarray:
        if not isinstance(node, tuple):
            return np.full(len(x), node)
        left = x[:, node[0]] <= node[1]
        out = np.empty(len(x))
        out[left], out[~left] = apply(node[2], x[left]), apply(node[3], x[~left])
        return out

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ts", kind="stable").reset_index(drop=True)
        x, y, half = np.array(part["x"].tolist(), float), part["y"].to_numpy(float), len(part) // 2
        if half < 2 * leaf:
            return pd.DataFrame({"series": [], "ts": [], "prediction": [], "y": []})
        base = float(y[:half].mean())
        fitted, out = np.full(half, base), np.full(len(part) - half, base)
        for _ in range(trees):
            tree = grow(x[:half], y[:half] - fitted, 2)
            fitted += rate * apply(tree, x[:half])
            out += rate * apply(tree, x[half:])
        return pd.DataFrame({"series": part["series"][half:], "ts": part["ts"][half:], "prediction": out, "y": y[half:]})

    return rows.groupBy("series").applyInPandas(run, "series string, ts timestamp_ntz, prediction double, y double")
