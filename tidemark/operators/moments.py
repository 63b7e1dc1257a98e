"""Linear models of every origin from running moments, and what interactions of features add to them.

An expanding fit needs only the sums of x, xx', xy and y over the rows whose
outcome was known by then. Time is cut into parts: each part's sums are
aggregated apart, a window over these few rows gives the sums before each part,
and a part's own rows are added in order within its task. So no task holds a
series, and every design that takes its columns from the same features is
solved from the same sums.

An interaction of standardised features is, for any training rows, linear in
products of the features; with these among the columns, its sums follow too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators.inference import long_run_z


@dataclass(frozen=True)
class Interaction:
    """The product of two groups' mean z-scores, or one group's where the gate, a feature of 0 and 1, is 1."""

    name: str
    a: tuple[str, ...]
    b: tuple[str, ...] = ()
    gate: str | None = None


@dataclass(frozen=True)
class Design:
    """A model: features, and perhaps an interaction as one more column."""

    name: str
    columns: tuple[str, ...]
    interaction: Interaction | None = None


class _Columns:
    """Features followed by the products that the designs' interactions need."""

    def __init__(self, names: Sequence[str], designs: Sequence[Design]):
        self.names = list(names)
        pairs = {(p, q) for d in designs if d.interaction for p in d.interaction.a for q in (d.interaction.b or (d.interaction.gate,))}
        self.pairs = sorted(pairs)
        self.at = {n: k for k, n in enumerate(self.names)} | {pair: len(self.names) + k for k, pair in enumerate(self.pairs)}
        self.size = len(self.at)

    def expanded(self, x: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Features less their shift, and products of those; a gate is never shifted."""
        x = x - shift
        return np.concatenate([x, *[x[:, [self.at[p]]] * x[:, [self.at[q]]] for p, q in self.pairs]], axis=1)

    def weights(self, design: Design, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(columns, constants): the design's columns as linear forms of all columns."""
        rows = [np.eye(self.size)[self.at[c]] for c in design.columns]
        constants = [0.0] * len(rows)
        if (i := design.interaction) is not None:
            row, constant = np.zeros(self.size), 0.0
            for p in i.a:
                k = self.at[p]
                for q in i.b or (i.gate,):
                    j = self.at[q]
                    centre, unit = (0.0, 1.0) if i.gate else (mean[j], scale[j])
                    share = 1 / (len(i.a) * max(1, len(i.b)) * scale[k] * unit)
                    row[self.at[p, q]] += share
                    row[k] -= share * centre
                    row[j] -= share * mean[k]
                    constant += share * mean[k] * centre
            rows.append(row)
            constants.append(constant)
        return np.array(rows), np.array(constants)


@dataclass
class _Sums:
    n: float
    x: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    y: float

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> _Sums:
        return cls(float(len(y)), x.sum(axis=0), x.T @ x, x.T @ y, float(y.sum()))

    @classmethod
    def unpacked(cls, flat: np.ndarray, d: int) -> _Sums:
        return cls(float(flat[0]), flat[2 : 2 + d].copy(), flat[2 + 2 * d :].reshape(d, d).copy(), flat[2 + d : 2 + 2 * d].copy(), float(flat[1]))

    def packed(self) -> np.ndarray:
        return np.concatenate([[self.n, self.y], self.x, self.xy, self.xx.ravel()])

    def add(self, x: np.ndarray, y: float) -> None:
        self.n, self.y = self.n + 1, self.y + y
        self.x += x
        self.xy += x * y
        self.xx += np.outer(x, x)


def _spread(second: np.ndarray, mean: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.maximum(second - mean * mean, 0))
    return np.where(sd < 1e-9, 1.0, sd)


def _elastic(gram: np.ndarray, right: np.ndarray, alpha: float, share: float) -> np.ndarray:
    """Coordinate descent on the correlations of standardised columns."""
    w = np.zeros(len(right))
    for _ in range(200):
        before = w.copy()
        for k in range(len(w)):
            rho = right[k] - gram[k] @ w + gram[k, k] * w[k]
            w[k] = np.sign(rho) * max(abs(rho) - alpha * share, 0) / (gram[k, k] + alpha * (1 - share))
        if np.abs(w - before).max() < 1e-8:
            break
    return w


def _fitted(sums: _Sums, columns: _Columns, design: Design, penalty: float, method: str):
    """A function from expanded rows to predictions: standardised columns, an intercept that isn't penalised."""
    mean = sums.x / sums.n
    forms, constants = columns.weights(design, mean, _spread(np.diag(sums.xx) / sums.n, mean))
    centre = forms @ mean + constants
    second = forms @ (sums.xx / sums.n) @ forms.T + np.outer(forms @ mean, constants) + np.outer(constants, forms @ mean) + np.outer(constants, constants)
    scale = _spread(np.diag(second), centre)
    gram = (second - np.outer(centre, centre)) / np.outer(scale, scale)
    base = sums.y / sums.n
    right = (forms @ (sums.xy / sums.n) + constants * base - centre * base) / scale
    w = np.linalg.solve(sums.n * gram + penalty * np.eye(len(right)), sums.n * right) if method == "ridge" else _elastic(gram, right, penalty, 0.6)
    return lambda x: base + ((x @ forms.T + constants - centre) / scale) @ w


KEY = ("series", "horizon")


def linear_replay(rows: DataFrame, names: Sequence[str], designs: Sequence[Design], penalty: float = 1.0, least: int = 48, part_hours: int = 168, method: str = "ridge", every_origin: bool = True) -> DataFrame:
    """(series, horizon, ts, y, design, prediction): each design's forecast at every origin from the rows known by then.

    rows: series, horizon in hours, ts, x, an array of finite features in the
    order of names, and y, null while unknown. An origin with fewer than `least`
    known rows has none. every_origin: fit at each origin; otherwise only at the
    start of each part. method: ridge with its penalty, or elastic with its alpha.
    """
    columns = _Columns(names, designs)
    d, gates = columns.size, [columns.at[i.gate] for i in {x.interaction for x in designs} if i is not None and i.gate]
    number = lambda at: F.floor(F.unix_timestamp(at.cast("timestamp")) / (3600 * part_hours))
    known_at = F.col("ts") + F.make_dt_interval(F.lit(0), F.col("horizon").cast("int"))
    shift = F.transform(F.first("x").over(W.partitionBy(*KEY).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)), lambda v, k: F.when(k.isin(gates) if gates else F.lit(False), 0.0).otherwise(v))
    shifted = rows.select(*KEY, "ts", "x", "y", shift.alias("shift"))  # the first row's features, so that squares don't cancel
    tests = shifted.select(*KEY, number(F.col("ts")).alias("part"), F.col("ts").alias("at"), F.lit(1).alias("test"), "ts", "x", "y", "shift")
    known = shifted.where("y IS NOT NULL").select(*KEY, number(known_at).alias("part"), known_at.alias("at"), F.lit(0).alias("test"), "ts", "x", "y", "shift")
    stacked = lambda part, c: np.array(part[c].tolist(), float).reshape(len(part), -1)

    def total(part: pd.DataFrame) -> pd.DataFrame:
        sums = _Sums.of(columns.expanded(stacked(part, "x"), stacked(part, "shift")), part["y"].to_numpy(float))
        return pd.DataFrame({"series": [part["series"].iloc[0]], "horizon": [part["horizon"].iloc[0]], "part": [part["part"].iloc[0]], "sums": [sums.packed()]})

    key_types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in KEY)
    totals = known.groupBy(*KEY, "part").applyInPandas(total, f"{key_types}, part long, sums array<double>")
    spans = tests.groupBy(*KEY).agg(F.explode(F.sequence(F.min("part"), F.max("part"))).alias("part"))
    each = spans.join(totals, [*KEY, "part"], "full").select(*KEY, "part", F.posexplode(F.coalesce("sums", F.array_repeat(F.lit(0.0), 2 + 2 * d + d * d))))
    before = F.sum("col").over(W.partitionBy(*KEY, "pos").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    prefix = each.select(*KEY, "part", "pos", F.coalesce(before, F.lit(0.0)).alias("v")).groupBy(*KEY, "part").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s")).select(*KEY, "part", F.col("s.v").alias("sums"))

    def fit(part: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(part) and len(sums):
            part = part.sort_values(["at", "test", "ts"], kind="stable")
            state = _Sums.unpacked(np.array(sums["sums"].iloc[0], float), d)
            x, y, test, ts = columns.expanded(stacked(part, "x"), stacked(part, "shift")), part["y"].to_numpy(float), part["test"].to_numpy(), part["ts"].to_numpy()
            models, series, horizon = None, part["series"].iloc[0], part["horizon"].iloc[0]
            for k in range(len(part)):
                if not test[k]:
                    if every_origin:
                        state.add(x[k], y[k])
                        models = None
                elif state.n >= least:
                    models = models or [_fitted(state, columns, design, penalty, method) for design in designs]
                    out += [(series, horizon, ts[k], y[k] if np.isfinite(y[k]) else None, design.name, float(m(x[k : k + 1])[0])) for design, m in zip(designs, models)]
        return pd.DataFrame(out, columns=["series", "horizon", "ts", "y", "design", "prediction"])

    shape = f"{key_types}, ts timestamp_ntz, y double, design string, prediction double"
    return tests.unionByName(known).groupBy(*KEY, "part").cogroup(prefix.groupBy(*KEY, "part")).applyInPandas(fit, shape)


def interaction_report(predictions: DataFrame, baseline: str, least: int = 100, least_blocks: int = 8, least_folds: int = 3, fold_days: int = 7, lags: int = 16) -> DataFrame:
    """(series, horizon, design, ...): what each design adds to the baseline at the same origins, how steadily over folds, and its status.

    A design is promoted on enough samples and blocks of `lags`, with a gain
    beyond its long-run error and in most of at least `least_folds` folds of time.
    """
    right = ((F.col("prediction") > 0) == (F.col("y") > 0)).cast("int")
    by, origin = ["series", "horizon", "design"], W.partitionBy("series", "horizon", "ts")
    known = predictions.where("y IS NOT NULL").withColumns({"error": F.abs(F.col("prediction") - F.col("y")), "right": right, "fold": F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / (86400 * fold_days))})
    base = lambda c: F.max(F.when(F.col("design") == baseline, F.col(c))).over(origin)
    pairs = known.withColumns({"base_error": base("error"), "base_right": base("right")}).where(F.col("design") != baseline).withColumn("gain", F.col("base_error") - F.col("error"))
    fold = W.partitionBy(*by, "fold")
    pairs = pairs.withColumns({"first": F.row_number().over(fold.orderBy("ts")) == 1, "fold_gain": F.avg("gain").over(fold)})
    means = {"baseline_mae": F.avg("base_error"), "candidate_mae": F.avg("error"), "baseline_direction": F.avg("base_right"), "candidate_direction": F.avg("right")}
    means |= {"folds": F.count_if("first"), "improved": F.count_if(F.col("first") & (F.col("fold_gain") > 0))}
    out = long_run_z(pairs, "gain", lags, "ts", *by, also=[c.alias(k) for k, c in means.items()])
    stable = (F.col("folds") >= least_folds) & (F.col("improved") / F.col("folds") > 0.5)
    few = (F.col("pairs") < least) | (F.col("pairs") / lags < least_blocks)
    status = F.when(few, "insufficient_evidence").when((F.col("z") > 1.96) & stable, "promoted").when(F.col("z") < -1.96, "rejected").otherwise("research_only")
    return out.withColumns({"relative_gain": 1 - F.col("candidate_mae") / F.nullif(F.col("baseline_mae"), F.lit(0.0)), "stable": stable, "status": status})


def interaction_overall(report: DataFrame) -> DataFrame:
    """(series, design, ...): of all horizons the mean relative gain, whether none loses much, and the recommendation."""
    count = lambda s: F.count_if(F.col("status") == s)
    out = report.groupBy("series", "design").agg(
        F.count("*").alias("horizons"), F.avg("relative_gain").alias("mean_gain"), (F.min("relative_gain") >= -0.05).alias("safe"), F.count_if(F.col("z") > 1.96).alias("better"),
        count("promoted").alias("promoted"), count("rejected").alias("rejected"),
    )
    recommendation = F.when((F.col("mean_gain") >= 0.01) & F.col("safe") & (F.col("better") >= 1), "edge_detected").when(F.col("mean_gain") < 0, "no_defensible_edge").otherwise("insufficient_evidence")
    promotion = F.when((F.col("promoted") >= 2) & (F.col("rejected") == 0), "promoted").when(F.col("rejected") > 0, "rejected").otherwise("insufficient_evidence")
    return out.withColumns({"recommendation": recommendation, "promotion": promotion})
