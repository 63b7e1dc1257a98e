"""Weights of models as they could be known at every origin, and replays of the policies that use them.

An outcome counts at an origin once its target time has come. What a policy
looks at, the newest so many of these, is the difference of two running sums
over outcomes in the order of their targets; a point-in-time join brings it to
the origins. So all origins are replayed in two windows over each series,
horizon and model, whatever the number of policies, and none is fitted again.

Rows are scored forecasts (forecasts.scored) with their regime. unit: what an
error of so many percent counts as one, 1 for prices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.scalars import bounded_normalize, let
from tidemark.operators.drift import Thresholds, adaptive_confidence, compared_windows, distribution_grade, severity
from tidemark.operators.inference import long_run_z
from tidemark.operators.pit import as_of

PERSISTENCE = "persistence"
ORIGIN = ("series", "origin_at", "horizon")
#: Samples from which weights are learned, and from which they are trusted fully.
LEAST, FULL = 6, 24
LEAST_BLEND, MOST_BLEND = 0.25, 0.80
FLOOR, CAP = 0.03, 0.55
#: Added to persistence where the others are no better on average.
BOOST = 0.12

MEASURES = ("n", "abs", "signed", "right", "within", "intervals")


def measures() -> dict[str, Column]:
    """What an outcome adds to each sum."""
    hit = F.col("within").cast("double")
    return dict(zip(MEASURES, (F.lit(1.0), F.col("abs_pct"), F.col("signed_pct"), F.col("direction_correct").cast("double"), F.coalesce(hit, F.lit(0.0)), hit.isNotNull().cast("double"))))


def outcomes(rows: DataFrame) -> DataFrame:
    return rows.where("actual > 0 AND abs_pct IS NOT NULL")


def running(rows: DataFrame, limits: Sequence[int], *keys: str) -> DataFrame:
    """(key, origin_at, past): from each outcome's target time on, the sums of the measures over the newest l outcomes, as past.l<l>."""
    order = W.partitionBy(*keys).orderBy("target_at")
    sums = F.struct(*[F.sum(c).over(order.rowsBetween(W.unboundedPreceding, 0)).alias(n) for n, c in measures().items()])
    summed = outcomes(rows).withColumn("__sum", sums)
    newest = lambda limit: F.struct(*[(F.col(f"__sum.{n}") - F.coalesce(F.lag(f"__sum.{n}", limit).over(order), F.lit(0.0))).alias(n) for n in MEASURES])
    return summed.select(F.struct(*keys).alias("__key"), F.col("target_at").alias("origin_at"), F.struct(*[newest(x).alias(f"l{x}") for x in limits]).alias("past"))


def with_past(rows: DataFrame, limits: Sequence[int], *by: str) -> DataFrame:
    """rows with own and whole: what was known at the origin of the model's newest outcomes in the origin's regime, and in all."""
    for name, keys in {"own": (*by, "series", "horizon", "model", "regime"), "whole": (*by, "series", "horizon", "model")}.items():
        asked = as_of(rows.withColumn("__key", F.struct(*keys)), running(rows, limits, *keys), "__key", "origin_at", F.col("past"))
        rows = asked.withColumn(name, F.col("found.value")).drop("__key", "found")
    return rows


def by_origin(rows: DataFrame, priors: Mapping[str, Mapping[str, float]], *by: str) -> DataFrame:
    """One row for each origin and horizon with m, an array of its models with their prior, prediction and past.

    priors: weights of models by regime; "" for all other regimes. Models
    without a positive prediction are left out, and the priors are normalised.
    """
    table = F.create_map(*[F.lit(x) for regime, shares in priors.items() for model, w in shares.items() for x in (f"{regime}/{model}", float(w))])
    own = table[F.concat_ws("/", F.when(F.col("regime").isin([r for r in priors if r]), F.col("regime")).otherwise(F.lit("")), F.col("model"))]
    model = F.struct("model", "predicted", F.coalesce(own, F.lit(0.0)).alias("prior"), "own", "whole")
    out = rows.where("predicted > 0 AND source_price > 0").groupBy(*by, *ORIGIN, "regime", "source_price", "actual").agg(F.array_sort(F.collect_list(model)).alias("m"))
    total = F.aggregate("m", F.lit(0.0), lambda acc, x: acc + x["prior"])
    return out.withColumn("m", F.transform("m", lambda x: x.withField("prior", x["prior"] / F.nullif(total, F.lit(0.0)))))


def _counted(side: str, past) -> Column:
    return F.array_min(F.transform("m", lambda x: F.coalesce(past(x[side])["n"], F.lit(0.0))))


def adaptive(groups: DataFrame, name: str, past, confidence: Column, unit: float = 1.0) -> DataFrame:
    """groups with <name>_source, <name>_stats and <name>_weights, one of each model of m.

    past(side) picks the sums of a model's side, own or whole. The regime's own
    outcomes count where every model has enough, else those of all regimes; where
    these are too few too, or the confidence is 0, the weights are the priors.
    """
    source, stats, weights = (f"{name}_{x}" for x in ("source", "stats", "weights"))
    own, whole = _counted("own", past), _counted("whole", past)
    learned = F.when(confidence <= 0, "drift_fallback")
    out = groups.withColumn(source, F.when(F.greatest(own, whole) < LEAST, "insufficient_history").otherwise(F.coalesce(learned, F.when(own >= LEAST, F.lit("regime")).otherwise("all_regimes"))))

    def measured(x: Column) -> Column:
        s = F.when(own >= LEAST, past(x["own"])).otherwise(past(x["whole"]))
        n = F.nullif(s["n"], F.lit(0.0))
        return F.struct(
            x["model"].alias("model"), F.coalesce(s["n"], F.lit(0.0)).alias("n"), (s["abs"] / n).alias("mae"), (s["right"] / n).alias("right"), (s["signed"] / n).alias("bias"),
            (s["within"] / F.nullif(s["intervals"], F.lit(0.0))).alias("coverage"), F.coalesce(s["intervals"], F.lit(0.0)).alias("intervals"), x["prior"].alias("prior"),
        )

    out = out.withColumn(stats, F.transform("m", measured)).withColumn("__naive", F.get(F.filter(stats, lambda s: s["model"] == PERSISTENCE), F.lit(0))["mae"])

    def score(s: Column) -> Column:
        base = F.exp(-2.5 * s["mae"] / unit) * (1 + 0.25 * (s["right"] - 0.5) * 2) * F.exp(-0.35 * F.abs(s["bias"]) / unit)
        base *= F.when(s["intervals"] >= 3, F.exp(-0.35 * F.abs(s["coverage"] - 0.8))).otherwise(1.0)
        worse = (s["model"] != PERSISTENCE) & (s["mae"] > F.col("__naive"))
        return F.greatest(base * F.when(worse, F.exp(1.5 * (F.col("__naive") - s["mae"]) / unit)).otherwise(1.0), F.lit(1e-9))

    out = out.withColumn("__raw", F.transform(stats, score)).withColumn("__sum", F.aggregate("__raw", F.lit(0.0), lambda acc, x: acc + x))
    least = F.array_min(F.transform(stats, lambda s: s["n"]))
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (least - LEAST) / (FULL - LEAST)))
    out = out.withColumns({"__blend": (LEAST_BLEND + (MOST_BLEND - LEAST_BLEND) * progress) * confidence, "__boost": F.when(naive_wins(stats), BOOST).otherwise(0.0)})
    mixed = F.zip_with(stats, "__raw", lambda s, r: (1 - F.col("__blend")) * s["prior"] + F.col("__blend") * r / F.col("__sum") + F.when(s["model"] == PERSISTENCE, F.col("__boost")).otherwise(0.0))
    out = out.withColumn("__mixed", mixed)
    fixed = F.col(source).isin("insufficient_history", "drift_fallback")
    out = out.withColumn(weights, F.when(fixed, F.transform(stats, lambda s: s["prior"])).otherwise(bounded_normalize(F.col("__mixed"), FLOOR, CAP)))
    return out.drop("__naive", "__raw", "__sum", "__blend", "__boost", "__mixed")


def naive_wins(stats: str) -> Column:
    """Whether the other models' mean error is no less than that of persistence."""
    others = F.filter(stats, lambda s: (s["model"] != PERSISTENCE) & s["mae"].isNotNull())
    mean = F.aggregate(others, F.lit(0.0), lambda acc, s: acc + s["mae"]) / F.nullif(F.size(others), F.lit(0))
    return F.coalesce(mean >= F.get(F.filter(stats, lambda s: s["model"] == PERSISTENCE), F.lit(0))["mae"], F.lit(False))


def blended(weights: str) -> Column:
    """The geometric mean of the models' prices by weight."""
    change = F.aggregate(F.zip_with("m", weights, lambda x, w: w * F.log(x["predicted"] / F.col("source_price"))), F.lit(0.0), lambda acc, x: acc + x)
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    return F.col("source_price") * F.exp(change / F.nullif(total, F.lit(0.0)))


def error_pct(price: Column) -> Column:
    return F.when(F.col("actual") > 0, F.abs(price - F.col("actual")) / F.col("actual") * 100)


def right_way(price: Column) -> Column:
    """Whether the price moved to the side of the origin that was forecast."""
    return F.when(F.col("actual") > 0, (F.signum(price - F.col("source_price")) == F.signum(F.col("actual") - F.col("source_price"))).cast("int"))


@dataclass(frozen=True)
class Expert:
    """How a regime's specialist learns: from how many outcomes, how far it is trusted, and what it adds to weights."""

    limit: int
    confidence: float
    cap: float
    reward: float
    boost: float


#: The specialists of the regimes, and the outcomes that the baseline looks at.
EXPERTS = {"range": Expert(160, 0.80, 0.38, 0.15, 0.10), "trending": Expert(240, 0.95, 0.55, 0.30, 0.0), "high_volatility": Expert(80, 0.70, 0.30, 0.10, 0.16)}
BASELINE_LIMIT = 200


def specialist_replay(rows: DataFrame, priors: Mapping[str, Mapping[str, float]], experts: Mapping[str, Expert] = EXPERTS, limit: int = BASELINE_LIMIT, unit: float = 1.0, spans: Mapping[int, int] | None = None) -> DataFrame:
    """Each origin and horizon with its regime, expert, fallback reason, and the price, error and direction of baseline and candidate.

    spans: outcomes to look at by horizon; then `spanned` is the price of weights from these.

    The baseline weighs models by what was known at the origin; the candidate
    does so with the specialist of the origin's regime. An origin without a known
    regime, or at which a horizon has too little history, takes the fallback: half
    equal weights, half the priors.
    """
    groups = by_origin(with_past(rows, sorted({limit, *[e.limit for e in experts.values()], *(spans or {}).values()})), priors)
    groups = adaptive(groups, "base", lambda s: s[f"l{limit}"], F.lit(1.0), unit)
    of = lambda field: reduce(lambda acc, r: acc.when(F.col("regime") == r, F.lit(getattr(experts[r], field))), experts, F.when(F.lit(False), F.lit(0.0)))

    def chosen(side: Column) -> Column:
        out = side[f"l{limit}"]
        for regime, e in experts.items():
            out = F.when(F.col("regime") == regime, side[f"l{e.limit}"]).otherwise(out)
        return out

    groups = adaptive(groups, "own", chosen, F.coalesce(of("confidence"), F.lit(1.0)), unit)
    sparse = F.max((F.col("base_source") == "insufficient_history").cast("int")).over(W.partitionBy("series", "origin_at")) == 1
    known = F.coalesce(F.col("regime").isin(list(experts)), F.lit(False))
    groups = groups.withColumn("fallback", F.when(~known, "unknown_regime").when(sparse, "sparse_history"))
    groups = groups.withColumn("__naive", naive_wins("own_stats"))
    raised = F.zip_with(
        "own_weights", "own_stats",
        lambda w, s: w * (1 + of("reward") * (F.coalesce(s["right"], F.lit(0.5)) - 0.5) * 2) + F.when((s["model"] == PERSISTENCE) & F.col("__naive"), of("boost")).otherwise(0.0),
    )
    n = F.size("m")
    cap = F.least(F.lit(CAP), F.greatest(F.coalesce(of("cap"), F.lit(CAP)), 1.0 / n + 1e-6))
    level = F.transform("m", lambda x: 0.5 * x["prior"] + 0.5 / n)
    groups = groups.withColumn("__raw", F.when(F.col("fallback").isNotNull(), level).otherwise(raised))
    groups = groups.withColumn("candidate_weights", F.when(n == 1, F.array(F.lit(1.0))).otherwise(bounded_normalize(F.col("__raw"), FLOOR, F.when(F.col("fallback").isNotNull(), CAP).otherwise(cap))))
    if spans:
        groups = adaptive(groups, "span", lambda side: reduce(lambda out, h: F.when(F.col("horizon") == h, side[f"l{spans[h]}"]).otherwise(out), spans, side[f"l{limit}"]), F.lit(1.0), unit)
        groups = groups.withColumn("spanned", blended("span_weights"))
    out = groups.withColumns({"baseline": blended("base_weights"), "candidate": blended("candidate_weights"), "expert": F.when(F.col("fallback").isNull(), F.col("regime")).otherwise("fallback")})
    measured = {f"{k}_{x}": f(F.col(k)) for k in ("baseline", "candidate") for x, f in (("error", error_pct), ("right", right_way))}
    kept = [*ORIGIN, "regime", "expert", "fallback", "base_source", "source_price", "actual", "baseline", "candidate", *(["spanned"] if spans else [])]
    return out.select(*kept, *[c.alias(k) for k, c in measured.items()])


def paired_report(rows: DataFrame, least: int, lags: int, *by: str) -> DataFrame:
    """(by, samples, both errors and directions, gain, z, verdict) of rows with baseline_ and candidate_ error and right; those without both have no gain and don't count."""
    known = rows.withColumn("__gain", F.col("baseline_error") - F.col("candidate_error"))
    means = [F.avg(f"{k}_{x}").alias(f"{k}_{y}") for k in ("baseline", "candidate") for x, y in (("error", "mae"), ("right", "direction"))]
    out = long_run_z(known, "__gain", lags, "origin_at", *by, also=means)
    verdict = F.when(F.col("pairs") < least, "low_sample").when(F.col("z") > 1.96, "candidate_better").when(F.col("z") < -1.96, "baseline_better").otherwise("inconclusive")
    return out.withColumn("verdict", verdict)


@dataclass(frozen=True)
class Decay:
    """A recency policy: technique is rolling (the newest `window`), exponential or linear (half-life or life in samples)."""

    name: str
    technique: str
    window: int
    life: int = 0
    blend: float = 0.45
    shift: float = 0.30

    def weight(self, age: Column) -> Column:
        if self.technique == "exponential":
            return F.exp(-F.log(F.lit(2.0)) * age / self.life)
        return F.greatest(1 - age / self.life, F.lit(0.0)) if self.technique == "linear" else F.lit(1.0)


#: The policies that are compared.
DECAYS = (
    Decay("rolling_24", "rolling", 24, blend=0.40, shift=0.25), Decay("rolling_48", "rolling", 48, blend=0.45, shift=0.30), Decay("recency_exp_6", "exponential", 24, 6, 0.50, 0.30),
    Decay("recency_exp_12", "exponential", 24, 12, 0.55, 0.35), Decay("recency_linear_12", "linear", 24, 12, 0.45, 0.30),
)


def decayed(rows: DataFrame, policies: Sequence[Decay], *keys: str) -> DataFrame:
    """(key, origin_at, past): from each outcome's target time on, the decayed sums of each policy over its newest outcomes.

    Windows are bounded by the policies' parameters, so an outcome looks back at a fixed number of others.
    """
    order = W.partitionBy(*keys).orderBy("target_at")
    most = max(p.window for p in policies)
    item = F.struct(*[c.alias(n) for n, c in measures().items()])
    seen = outcomes(rows).withColumn("__new", F.reverse(F.collect_list(item).over(order.rowsBetween(1 - most, 0))))

    def sums(p: Decay) -> Column:
        start = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "w", "ww", "aged", *MEASURES[1:])])
        weighted = ("abs", "signed", "right")

        def add(acc: Column, i: Column) -> Column:
            more = {"n": F.lit(1.0), "w": i["w"], "ww": i["w"] * i["w"], "aged": i["w"] * i["age"]} | {c: i["w"] * i["x"][c] if c in weighted else i["x"][c] for c in MEASURES[1:]}
            return F.struct(*[(acc[k] + v).alias(k) for k, v in more.items()])

        aged = F.transform(F.slice("__new", 1, p.window), lambda x, age: F.struct(p.weight(age).cast("double").alias("w"), age.cast("double").alias("age"), x.alias("x")))
        return F.aggregate(aged, start, add)

    return seen.select(F.struct(*keys).alias("__key"), F.col("target_at").alias("origin_at"), F.struct(*[sums(p).alias(p.name) for p in policies]).alias("past"))


def drift_grades(rows: DataFrame, recent: int = 8, before: int = 24, limits: Thresholds = Thresholds(), *by: str) -> DataFrame:
    """(by, series, origin_at, grade): the severest drift of absolute errors of any model and horizon that could be seen at each origin."""
    keys = [*by, "series", "horizon", "model"]
    order = W.partitionBy(*keys).orderBy("target_at").rowsBetween(1 - recent - before, 0)
    seen = outcomes(rows).withColumn("__new", F.reverse(F.collect_list("abs_pct").over(order))).where(F.size("__new") == recent + before)
    seen = seen.withColumns({"x": F.sort_array(F.slice("__new", 1, recent)), "y": F.sort_array(F.slice("__new", recent + 1, before))})
    graded_ = compared_windows(seen).select(F.struct(*keys).alias("__key"), F.col("target_at").alias("origin_at"), distribution_grade(limits).alias("grade"))
    asked = as_of(rows.select(*keys, "origin_at", F.struct(*keys).alias("__key")), graded_, "__key", "origin_at", F.col("grade"))
    return asked.groupBy(*by, "series", "origin_at").agg(F.coalesce(F.max("found.value"), F.lit(0)).alias("grade"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _shifted(p: Decay, unit: float) -> Column:
    """A policy's weights from those of production, what held it back, and how old its samples are on average."""
    past = lambda side: side[p.name]
    own, whole = _counted("own", past), _counted("whole", past)
    production = F.col("production_weights")

    def score(s: Column) -> Column:
        base = F.exp(-2.5 * s["abs"] / s["w"] / unit) * (1 + 0.25 * (s["right"] / s["w"] - 0.5) * 2) * F.exp(-0.35 * F.abs(s["signed"] / s["w"]) / unit)
        off = F.when(s["intervals"] >= 3, F.exp(-0.35 * F.abs(s["within"] / F.nullif(s["intervals"], F.lit(0.0)) - 0.8))).otherwise(1.0)
        return F.greatest(base * off, F.lit(1e-9))

    def fields(weights: Column, anchored: int, capped: Column, memory: Column) -> Column:
        return F.struct(weights.alias("weights"), F.lit(anchored).alias("anchored"), capped.cast("int").alias("capped"), memory.alias("memory"))

    def moved(picked: Column, delta: Column) -> Column:
        memory = _sum(F.transform(picked, lambda s: s["aged"])) / F.nullif(_sum(F.transform(picked, lambda s: s["w"])), F.lit(0.0))
        near = lambda far: F.zip_with(production, delta, lambda w, d: w + d * F.when(far > p.shift, p.shift / far).otherwise(1.0))
        return let(F.array_max(F.transform(delta, F.abs)), lambda far: fields(near(far), 0, far > p.shift, memory))

    def changed(picked: Column, raw: Column) -> Column:
        worth = F.array_min(F.transform(picked, lambda s: s["w"] * s["w"] / s["ww"]))
        blend = p.blend * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (worth - LEAST) / (FULL - LEAST))) * F.col("confidence")
        return let(F.struct(blend.alias("b"), _sum(raw).alias("t")), lambda c: let(F.zip_with(production, raw, lambda w, r: c["b"] * (r / c["t"] - w)), lambda delta: moved(picked, delta)))

    found = let(F.transform("m", lambda x: F.when(own >= LEAST, past(x["own"])).otherwise(past(x["whole"]))), lambda picked: let(F.transform(picked, score), lambda raw: changed(picked, raw)))
    stays = fields(production, 1, F.lit(False), F.lit(None).cast("double"))
    return F.when(F.greatest(own, whole) < LEAST, stays).otherwise(found)


def recency_replay(rows: DataFrame, folded: DataFrame, priors: Mapping[str, Mapping[str, float]], policies: Sequence[Decay] = DECAYS, limit: int = BASELINE_LIMIT, unit: float = 1.0) -> DataFrame:
    """Each validation origin and horizon of purged folds with every policy: its price's error and direction, the change of its
    weights since the origin before, the mean age of its samples, whether it stayed with production, and whether its shift was capped.

    folded: (fold, role, series, ts) of evaluate.folds(). What a fold may look
    at are its training rows and its own earlier validation rows, each once its
    outcome was known. Policies move from the production weights, whose trust
    falls with the drift seen at the origin; production and persistence are
    among the policies.
    """
    mine = rows.join(folded.withColumnRenamed("ts", "origin_at"), ["series", "origin_at"])
    grades = drift_grades(mine, 8, 24, Thresholds(), "fold")
    past = with_past(mine, [limit], "fold").withColumnsRenamed({"own": "own0", "whole": "whole0"})
    for name, keys in {"own1": ("fold", "series", "horizon", "model", "regime"), "whole1": ("fold", "series", "horizon", "model")}.items():
        asked = as_of(past.withColumn("__key", F.struct(*keys)), decayed(mine, policies, *keys), "__key", "origin_at", F.col("past"))
        past = asked.withColumn(name, F.col("found.value")).drop("__key", "found")
    names = [p.name for p in policies]
    both = lambda k: F.struct(F.col(f"{k}0.l{limit}").alias(f"l{limit}"), *[F.col(f"{k}1.{n}").alias(n) for n in names])
    asked = past.where("role = 'validate'").withColumns({"own": both("own"), "whole": both("whole")})
    groups = by_origin(asked, priors, "fold").join(grades, ["fold", "series", "origin_at"], "left")
    groups = groups.withColumn("segment", F.when(F.col("grade") > 0, "drift").otherwise("normal")).withColumn("confidence", adaptive_confidence(severity(F.col("grade"))))
    groups = adaptive(groups, "production", lambda s: s[f"l{limit}"], F.col("confidence"), unit)
    naive = F.transform("m", lambda x: (x["model"] == PERSISTENCE).cast("double"))
    plain = lambda w: F.struct(w.alias("weights"), F.lit(0).alias("anchored"), F.lit(0).alias("capped"), F.lit(None).cast("double").alias("memory"))
    choices = {"production": plain(F.col("production_weights")), PERSISTENCE: plain(naive)} | {p.name: _shifted(p, unit) for p in policies}
    each = F.array(*[F.struct(F.lit(n).alias("policy"), c.alias("c")) for n, c in choices.items()])
    shown = ["fold", *ORIGIN, "segment", "source_price", "actual", "m"]
    long = groups.select(*shown, F.explode(each).alias("p")).select(*shown, "p.policy", "p.c.*")
    price = F.coalesce(blended("weights"), F.col("source_price"))
    before = F.lag("weights").over(W.partitionBy("fold", "series", "horizon", "policy").orderBy("origin_at"))
    turnover = F.when(F.size(before) == F.size("weights"), F.aggregate(F.zip_with(before, "weights", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: acc + x))
    return long.withColumns({"error": error_pct(price), "right": right_way(price), "turnover": turnover}).drop("m", "weights")


def recency_report(replay: DataFrame, least: int, lags: int, *by: str) -> DataFrame:
    """(by, policy, ...): errors, stability and guards of every policy, and its gain over production with a verdict."""
    origin = W.partitionBy("fold", *ORIGIN)
    both = replay.withColumn("__base", F.max(F.when(F.col("policy") == "production", F.col("error"))).over(origin)).withColumn("__gain", F.col("__base") - F.col("error"))
    means = [F.avg(c).alias(n) for n, c in (("mae", "error"), ("direction", "right"), ("turnover", "turnover"), ("memory", "memory"))] + [F.sum(c).alias(c) for c in ("anchored", "capped")]
    out = long_run_z(both, "__gain", lags, "origin_at", *by, "policy", also=means).withColumnRenamed("pairs", "samples")
    verdict = F.when(F.col("samples") < least, "low_sample").when(F.col("z") > 1.96, "candidate_better").when(F.col("z") < -1.96, "baseline_better").otherwise("inconclusive")
    return out.withColumn("verdict", F.when(F.col("policy") != "production", verdict))


#: Outcomes that the specialist of each horizon looks at.
SPANS = {2: 80, 4: 120, 8: 160, 16: 240}
SPECIALISTS = ("baseline", "spanned", "candidate")


def simplex_fit(gram: np.ndarray, right: np.ndarray, ridge: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Non-negative weights that sum to 1, by gradient steps that are cut at 0 and scaled back."""
    matrix = gram + ridge * np.eye(len(right))
    w, step = np.full(len(right), 1 / len(right)), 1 / max(float(np.linalg.norm(matrix, 2)), 1.0)
    for _ in range(steps):
        w = np.maximum(w - step * (matrix @ w - right), 0)
        w = w / w.sum() if w.sum() else np.full(len(w), 1 / len(w))
    return w


def stack_replay(replay: DataFrame, folded: DataFrame, specialists: Sequence[str] = SPECIALISTS) -> DataFrame:
    """Validation origins of purged folds with the stacked price and its error, and those of the first specialist and of persistence.

    replay: specialist_replay() with spans; folded: (fold, role, series, ts). The
    weights of a fold, series and horizon come from the second moments of its
    training rows' relative changes, summed in one window; without training rows
    they are equal. Unusable rows add nothing and go after that window, so that
    the condition isn't written out down to the sources.
    """
    x = [F.col(c) / F.col("source_price") - 1 for c in specialists]
    y = F.col("actual") / F.col("source_price") - 1
    key = ["fold", "series", "horizon"]
    usable = reduce(lambda a, c: a & F.col(c).isNotNull(), specialists, F.col("actual") > 0)
    mine = replay.join(folded.withColumnRenamed("ts", "origin_at"), ["series", "origin_at"]).withColumn("__usable", F.coalesce(usable, F.lit(False)))
    group = W.partitionBy(*key)
    trains = F.col("__usable") & (F.col("role") == "train")
    train = lambda c: F.coalesce(F.sum(F.when(trains, c)).over(group), F.lit(0.0))
    n = len(specialists)
    sums = {"trained": F.count_if(trains).over(group), "gram": F.array(*[train(a * b) for a in x for b in x]), "right": F.array(*[train(a * y) for a in x])}
    asked = mine.withColumns(sums).where("role = 'validate' AND __usable")

    def fit(batches):
        known: dict[tuple, list[float]] = {}  # one fit for each fold, series and horizon
        for batch in batches:
            weights = []
            for g, r, t in zip(batch["gram"], batch["right"], batch["trained"]):
                found = (t, *g, *r)
                if found not in known:
                    known[found] = simplex_fit(np.array(g, float).reshape(n, n), np.array(r, float)).tolist() if t else [1 / n] * n
                weights.append(known[found])
            yield batch.drop(columns=["gram", "right"]).assign(weights=weights)

    kept = asked.select(*key, "origin_at", "regime", "source_price", "actual", *specialists, "trained", "gram", "right")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name not in ("gram", "right"))
    fitted = kept.mapInPandas(fit, f"{types}, weights array<double>")
    stacked = sum((F.col("weights")[k] * F.col(c) for k, c in enumerate(specialists)), F.lit(0.0))
    out = fitted.withColumn("stacked", stacked)
    agrees = lambda price: ((price - F.col("source_price")) * (F.col("actual") - F.col("source_price")) >= 0).cast("int")
    prices = {"stack": F.col("stacked"), "production": F.col(specialists[0]), "persistence": F.col("source_price")}
    return out.select(*key, "origin_at", "regime", "trained", "weights", "stacked", *[c.alias(f"{k}_{name}") for k, p in prices.items() for name, c in (("error", error_pct(p)), ("right", agrees(p)))])


def stack_report(stacked: DataFrame, least: int, lags: int, *by: str) -> DataFrame:
    """(against, segment, by, ...): the stack against production and persistence, over all and in each regime."""
    versus = F.array(*[F.struct(F.lit(k).alias("against"), F.col(f"{k}_error").alias("baseline_error"), F.col(f"{k}_right").alias("baseline_right")) for k in ("production", "persistence")])
    long = stacked.withColumnsRenamed({"stack_error": "candidate_error", "stack_right": "candidate_right"}).withColumn("v", F.explode(versus)).withColumn("segment", F.explode(F.array(F.lit("overall"), F.col("regime"))))
    return paired_report(long.select("*", "v.*"), least, lags, "against", "segment", *by)


@dataclass(frozen=True)
class Uncertainty:
    """How the calibration of intervals discounts a model's weight."""

    limit: int = 200
    target: float = 0.8
    gap: float = 0.15
    least: int = 6
    full: int = 24
    strength: float = 0.6
    blend: float = 0.7
    ratio: float = 2.0
    evidence: int = 32


def uncertainty_replay(rows: DataFrame, priors: Mapping[str, Mapping[str, float]], config: Uncertainty = Uncertainty(), limit: int = BASELINE_LIMIT, unit: float = 1.0) -> DataFrame:
    """Each origin and horizon with the prices of adaptive weights and of the same discounted by calibrated uncertainty, and calibration,
    an array of every model's samples, coverage, error, state and penalty as known at the origin.

    A model whose newest intervals missed the target share by e keeps
    1 - b (1 - exp(-strength e)) of its weight, b growing with its intervals; one
    with too few has none taken away. A leader without enough evidence, or
    overconfident, gets at most `ratio` times the runner-up's.
    """
    groups = adaptive(by_origin(with_past(rows, sorted({limit, config.limit})), priors), "base", lambda s: s[f"l{limit}"], F.lit(1.0), unit)

    def judged(x: Column) -> Column:
        s = x["whole"][f"l{config.limit}"]
        n = F.coalesce(s["intervals"], F.lit(0.0))
        coverage = s["within"] / F.nullif(n, F.lit(0.0))
        error, known = F.abs(coverage - config.target), n >= config.least
        progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (n - config.least) / (config.full - config.least)))
        penalty = F.when(known, 1 - config.blend * progress * (1 - F.exp(-config.strength * error))).otherwise(1.0)
        over = known & (coverage < config.target - config.gap)
        return F.struct(x["model"].alias("model"), n.alias("samples"), coverage.alias("coverage"), error.alias("error"), F.when(known, "calibrated").otherwise("sparse_fallback").alias("state"), F.coalesce(over, F.lit(False)).alias("overconfident"), penalty.alias("penalty"))

    groups = groups.withColumn("calibration", F.transform("m", judged))
    groups = groups.withColumn("__raw", F.zip_with("base_weights", "calibration", lambda w, c: w * c["penalty"]))
    places = F.reverse(F.array_sort(F.zip_with("__raw", "calibration", lambda w, c: F.struct(w.alias("w"), ((c["samples"] >= config.evidence) & ~c["overconfident"]).alias("proved"), c["model"].alias("model")))))
    groups = groups.withColumn("__top", places)
    leader, second = F.get("__top", F.lit(0)), F.get("__top", F.lit(1))
    clipped = second.isNotNull() & ~leader["proved"] & (leader["w"] > config.ratio * second["w"])
    groups = groups.withColumn("clipped", F.coalesce(clipped, F.lit(False)))
    guarded = F.zip_with("__raw", "calibration", lambda w, c: F.when(F.col("clipped") & (c["model"] == F.get("__top", F.lit(0))["model"]), config.ratio * F.get("__top", F.lit(1))["w"]).otherwise(w))
    groups = groups.withColumn("__guarded", guarded)
    fixed = F.col("base_source") == "insufficient_history"
    groups = groups.withColumn("candidate_weights", F.when(fixed, F.col("base_weights")).otherwise(bounded_normalize(F.col("__guarded"), FLOOR, CAP)))
    out = groups.withColumns({"baseline": blended("base_weights"), "candidate": blended("candidate_weights")})
    measured = {f"{k}_{x}": f(F.col(k)) for k in ("baseline", "candidate") for x, f in (("error", error_pct), ("right", right_way))}
    return out.select(*ORIGIN, "regime", "base_source", "source_price", "actual", "clipped", "calibration", "baseline", "candidate", *[c.alias(k) for k, c in measured.items()])
