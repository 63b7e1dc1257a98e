"""Mixing sources to target weights by hierarchical budgets.

Documents are leaves of a tree of levels, as domain, language and source. The
corpus budget goes down the tree: a node shares its budget among its children by
weight, but none gets more than the tokens below it times MAX_EPOCHS; what one
can't use is shared by its siblings, again by weight, and only what all of them
can't use is left to the level above. A leaf of budget b and n tokens takes
whole epochs b div n times, and of the next one a prefix in an order seeded by
epoch: all documents whose running total of tokens stays within the rest.

The prefix of a leaf is found without sorting it in one place. The order's
numbers fall into 1024 cells; totals by leaf and cell tell in which cell the
budget ends, and only that one is summed up document by document. The outcome is
one number for each leaf, up to which the order is taken, so texts are never
shuffled: selecting is a filter.

Defined results: tokens are runs of characters other than space and tab to
carriage return; a null or empty text has none and is taken like any
other, at no cost; a null level is a node of its own, weighted
as the text `(none)`; nodes without a given weight weigh 1, a weight of 0 takes
nothing; rows that are equal in id and text are taken together; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemark.llm.common import read, written

#: Plans of at most so many leaves are broadcast; larger ones are joined.
FEW = 10_000
NONE = "(none)"


@dataclass(frozen=True)
class Mix:
    """Weights by level and value, the share of the corpus's tokens to draw, and the most epochs of a leaf."""

    weights: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    share: float = 0.9
    max_epochs: int = 2
    seed: int = 17


def shared(budget: int, weights: Sequence[float], most: Sequence[int]) -> list[int]:
    """budget by weight under limits; what one leaves goes to the others, and units left by rounding to the first that have room."""
    given, open_ = [0] * len(weights), [k for k, w in enumerate(weights) if w > 0 and most[k] > 0]
    while open_ and budget > sum(given):
        rest, total = budget - sum(given), sum(weights[k] for k in open_)
        wanted = {k: int(rest * weights[k] / total) for k in open_}
        full = [k for k in open_ if given[k] + wanted[k] >= most[k]]
        if full:
            for k in full:
                given[k] = most[k]
            open_ = [k for k in open_ if k not in full]
            continue
        for k in open_:
            given[k] += wanted[k]
        for k in open_:
            if budget > sum(given) and given[k] < most[k]:
                given[k] += 1
        open_ = [k for k in open_ if given[k] < most[k]]
    return given


def budgets(tokens: Mapping[tuple[str, ...], int], levels: Sequence[str], mix: Mix) -> dict[tuple[str, ...], int]:
    """Every leaf's budget; a path has a value for each level."""
    weight = lambda node: mix.weights.get(levels[len(node) - 1], {}).get(node[-1], 1.0)
    below: dict[tuple[str, ...], int] = {}
    for leaf, n in tokens.items():
        for k in range(len(leaf) + 1):
            below[leaf[:k]] = below.get(leaf[:k], 0) + n
    children: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for node in sorted(below):
        if node:
            children.setdefault(node[:-1], []).append(node)
    most: dict[tuple[str, ...], int] = {}
    for node in sorted(below, key=len, reverse=True):
        most[node] = sum(most[c] for c in children[node] if weight(c) > 0) if node in children else below[node] * mix.max_epochs
    out = {(): min(int(mix.share * below.get((), 0)), most.get((), 0))}
    for node in sorted(children, key=lambda p: (len(p), p)):
        own = children[node]
        out |= dict(zip(own, shared(out[node], [weight(c) for c in own], [most[c] for c in own])))
    return {leaf: out[leaf] for leaf in tokens}


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(mix: Mix, epoch: Column | str, row: Column | str) -> Column:
    """A row's number, from 0 to 2^63, in the order of an epoch."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(mix.seed), epoch, row), 1)


def plan_mix(rows: DataFrame, levels: Sequence[str], mix: Mix) -> DataFrame:
    """For each leaf its budget, whole epochs, and up to which place it takes of the next; rows: levels, tokens, row."""
    spark = rows.sparkSession
    tokens = {tuple(r[k] for k in levels): r["tokens"] for r in rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens")).collect()}
    given = budgets(tokens, levels, mix)
    leaves = [(*leaf, b, int(b // max(1, tokens[leaf])), int(b % max(1, tokens[leaf]))) for leaf, b in sorted(given.items())]
    plan = spark.createDataFrame(leaves, ", ".join([*[f"`{k}` string" for k in levels], "leaf_budget long, epochs int, rest long"]))
    plan = F.broadcast(plan) if len(leaves) <= FEW else plan
    begun = rows.join(plan.where("rest > 0"), list(levels)).select(*levels, "tokens", "rest", place(mix, "epochs", "row").alias("place"))
    begun = begun.withColumn("cell", F.shiftright("place", 53))
    cells = begun.groupBy(*levels, "cell", "rest").agg(F.sum("tokens").alias("cell_tokens"))
    cells = cells.withColumn("start", F.sum("cell_tokens").over(W.partitionBy(*levels).orderBy("cell")) - F.col("cell_tokens"))
    last = cells.where("start <= rest AND start + cell_tokens > rest").select(*levels, "cell", "start")
    upto = F.col("start") + F.sum("tokens").over(W.partitionBy(*levels).orderBy("place").rangeBetween(W.unboundedPreceding, 0))
    inside = begun.join(last, [*levels, "cell"]).withColumn("upto", upto)
    cut = F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("place"))), F.shiftleft(F.first("cell"), 53) - 1)
    cuts = inside.groupBy(*levels).agg(cut.alias("cut"))
    known = plan.join(cuts, list(levels), "left").select(*levels, "leaf_budget", "epochs", F.coalesce("cut", F.lit(-1)).alias("cut"))
    return F.broadcast(written(known)) if len(leaves) <= FEW else written(known)


def select_mix(docs: DataFrame, levels: Mapping[str, Column], mix: Mix, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that the mix takes, once for each epoch, with the columns epoch, tokens and leaf_budget.

    levels: the tree's levels from the top, with their columns. Leaves, not
    rows, are budgeted on the driver: as many as there are paths.
    """
    names = [f"__{k}" for k in levels]
    by_level = Mix({f"__{k}": v for k, v in mix.weights.items()}, mix.share, mix.max_epochs, mix.seed)
    nodes = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(k) for k, c in zip(names, levels.values())]
    row = F.xxhash64(F.col(doc_id), F.col(text))
    plan = plan_mix(written(docs.select(*nodes, token_count(F.col(text)).alias("tokens"), row.alias("row"))), names, by_level)
    kept = [c for c in docs.columns if c.lower() not in ("epoch", "tokens", "leaf_budget")]
    rows = docs.select(*kept, *nodes, token_count(F.col(text)).alias("__tokens"), row.alias("__row")).join(plan, names)
    whole = F.when(F.col("epochs") > 0, F.sequence(F.lit(0), F.col("epochs") - 1)).otherwise(F.array().cast("array<int>"))
    begun = F.when(place(mix, "epochs", "__row") <= F.col("cut"), F.array("epochs")).otherwise(F.array().cast("array<int>"))
    return rows.select(*kept, F.explode(F.concat(whole, begun)).alias("epoch"), F.col("__tokens").alias("tokens"), "leaf_budget")


#: The mix of the registered query: four domains, told by source, then languages and sources.
DOMAINS = 4
PRODUCTION = Mix({"domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, "lang": {"en": 6.0, "de": 2.0, "fr": 2.0, "es": 2.0}})


def domain_of(source: Column) -> Column:
    return F.concat(F.lit("d"), F.crc32(source.cast("binary")) % DOMAINS)


def tree_levels() -> dict[str, Column]:
    return {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn to target weights of domains, languages and sources, up to two epochs of each."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    taken = select_mix(docs, tree_levels(), PRODUCTION)
    return taken.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", "epoch", "tokens", "leaf_budget")
