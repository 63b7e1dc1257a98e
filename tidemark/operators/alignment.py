"""What several sources, each on a clock of its own, had last said at every origin.

All sources and origins are one union that is shuffled once by key and part of
time. A part starts from the last rows that the parts before it held, which are
one small row a part, so a key with a third of all rows is many tasks.

Sources are rows (key, time at which they were known, values); of rows of a
source known at the same time the greatest by its values counts. Rows without
key or time are never found; an origin without them stays and finds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators import moments


@dataclass(frozen=True)
class Source:
    """Rows with the key and time columns of the origins and some numeric values; those older than `most_seconds` are stale."""

    name: str
    rows: DataFrame
    values: tuple[str, ...]
    most_seconds: int | None = None

    def columns(self) -> list[str]:
        """The names that its values get beside those of other sources."""
        return [f"{self.name}_{v}" for v in self.values]


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def aligned(origins: DataFrame, sources: Sequence[Source], key: str, at: str, part_seconds: int = 7 * 86400) -> DataFrame:
    """origins with {source}_at and {source}_{value} of the last row of each source known at or before, if it isn't stale."""
    names = [f"__{s.name}" for s in sources]
    own = origins.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in origins.columns]).alias("__row"))
    each = [
        s.rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(0).alias("__side"), F.struct(F.col(at).alias("at"), *s.values).alias(n))
        for s, n in zip(sources, names)
    ]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each, own)
    both = both.withColumn("__part", F.floor(_micros(F.col("__at")) / (part_seconds * 1_000_000)))
    before = W.partitionBy("__key").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    ends = both.groupBy("__key", "__part").agg(*[F.max(n).alias(n) for n in names])
    carried = ends.select("__key", "__part", *[F.last(n, ignorenulls=True).over(before).alias(f"{n}_before") for n in names])
    within = W.partitionBy("__key", "__part").orderBy("__at", "__side", *names).rowsBetween(W.unboundedPreceding, 0)
    found = both.join(carried, ["__key", "__part"], "left").withColumns({f"{n}_found": F.coalesce(F.last(n, ignorenulls=True).over(within), F.col(f"{n}_before")) for n in names})
    shown = []
    for s, n in zip(sources, names):
        last = F.col(f"{n}_found")
        fresh = last if s.most_seconds is None else F.when(_micros(F.col("__at")) - _micros(last["at"]) <= s.most_seconds * 1_000_000, last)
        shown += [fresh["at"].alias(f"{s.name}_at"), *[fresh[v].alias(c) for v, c in zip(s.values, s.columns())]]
    return found.where("__side = 1").select("__row.*", *shown)


def completed(frame: DataFrame, base: Sequence[str], sources: Sequence[Source]) -> DataFrame:
    """frame with missing, the sources (and base) of which a value is absent or not finite, in order, and complete, if there are none.

    All designs of a comparison are fitted on complete rows, so that they meet the same origins.
    """
    finite = lambda c: F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    whole = {"base": list(base)} | {s.name: s.columns() for s in sources}
    absent = [F.when(~F.forall(F.array(*[finite(c) for c in columns]), lambda g: g), F.lit(name)) for name, columns in whole.items() if columns]
    return frame.withColumn("missing", F.array_compact(F.array(*absent))).withColumn("complete", F.size("missing") == 0)


def source_report(rows: DataFrame, base: Sequence[str], sources: Sequence[Source], penalty: float = 1.0, least: int = 100) -> DataFrame:
    """What each source and all of them add to a ridge model of the base at the same origins.

    rows: (series, horizon, ts, x, y) with x the base and then the columns of the sources in order.
    """
    names = [*base, *[c for s in sources for c in s.columns()]]
    designs = [moments.Design("base", tuple(base)), *[moments.Design(s.name, (*base, *s.columns())) for s in sources]]
    designs += [moments.Design("all", tuple(names))] if len(sources) > 1 else []
    return moments.interaction_report(moments.linear_replay(rows, names, designs, penalty, least), "base")
