"""Near-duplicate components by an LSH forest over MinHash signatures.

Every distinct shingle set has 128 minima, and TREES orders read them from
different places on, wrapping around. In each order the signatures are sorted,
so that sets with a common prefix stand together, however deep it goes; the
depth to which a region of the order is told apart is that of the common
prefixes in it. Two sets lie in one region of an order if their first NEAR
values agree: with 32 orders of 4 values a pair of similarity 0.75 meets in at
least one with probability 1 - 5e-6, more similar pairs more surely.

1. Candidates are a set and its longest-common-prefix neighbours: of the sets
   next to it in any order, that with the longest prefix. Those that this leaves
   without a link go on to their next longest, ROUNDS times in all, so crowded
   regions are compared at great depth and sparse ones at less.
2. Neighbours can miss a link between groups. So all sets of regions whose sets
   aren't all connected by then are joined exactly, by the prefix filter of set
   joins: of n shingles in one common order, the first n - ceil(0.75 n) + 1 hold
   one that a partner of similarity 0.75 has among its own first ones, and from
   the first such one on both have as many left as they must share. The order
   puts shingles first that only one component has; they join nothing, so sets
   that share text but not enough of it drop out before anything is paired. In
   a few rounds each set is first compared with some that are drawn at each of
   its shingles, which makes one component of a crowd of near copies; only what
   stays in different ones is paired, and the largest component at a shingle
   never with itself.

All candidates are confirmed on full sets. Orders are sorted over ranges of
(order, signature, set), so a crowded region is as many tasks as it fills.

Defined results: a document without words or text has an empty set and is its
own component; fewer than five words are one shingle; equal sets, told by the
128-bit digest of the whole set, are linked; rows that share an id are one node, which has all of their texts;
a row without an id is linked with nothing, has no component and is kept. Only
the id and text columns are read. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from tidemark.llm.common import drop_table, give_back, read, smallest_labels, written
from tidemark.llm.shingles import shingle_sets, signatures

WIDTH = 5
PERCENT = 75
TREES = 32
#: Values of a signature that a region shares, and values by which an order is sorted.
NEAR, DEPTH = 4, 12
VALUES = NEAR * TREES
ROUNDS = 3
#: Rounds of joining components by samples at most, and how few links of its pairs end them: one in so many.
MERGES, FEW = 8, 50
#: Sets that are drawn at a shingle in such a round.
HOSTS = 3
#: Width of the classes of set sizes in which pairs are looked for.
SIZE_STEP = 0.05
#: Bytes of text that are hashed at a time.
SLICE = 1 << 17


def _slices(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    coded = [(t or "").encode() for t in batch["text"]]
    start, size = 0, 0
    for i, t in enumerate(coded):
        size += len(t)
        if size >= SLICE or i == len(coded) - 1:
            yield batch.iloc[start : i + 1], coded[start : i + 1]
            start, size = i + 1, 0


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for rows, coded in _slices(batch):
            values, counts = shingle_sets(coded, WIDTH)
            filled = np.flatnonzero(counts)
            minima = signatures(values, counts[filled], VALUES).T.astype(">u4") if len(filled) else None
            at, ends = np.cumsum(counts > 0) - 1, np.cumsum(counts)
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"].values,
                    "n_shingles": counts.astype(np.int64),
                    "digest": [hashlib.blake2b(values[e - n : e], digest_size=16).digest() for e, n in zip(ends, counts)],
                    "minima": [minima[at[i]].tobytes() if counts[i] else None for i in range(len(counts))],
                }
            )
    give_back()


def _full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for rows, coded in _slices(batch):
            values, counts = shingle_sets(coded, WIDTH)
            parts = np.split(values.view(np.int64), np.cumsum(counts)[:-1])
            digests = [hashlib.blake2b(p, digest_size=16).digest() for p in parts]
            yield pd.DataFrame({"node": rows["doc_id"].values, "digest": digests, "shingles": parts})
    give_back()


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with both sizes and the size of the intersection of their full sets."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(b, "b").join(a, "a")
    return both.select("a", "b", F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"), F.size(F.array_intersect("set_a", "set_b")).alias("common"))


def linked(sizes: DataFrame) -> DataFrame:
    return sizes.where(100 * F.col("common") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("common")))


def order_key(tree: Column, values: int) -> Column:
    """The first values of a signature as an order reads it."""
    return F.substring(F.concat("minima", "minima"), 4 * NEAR * tree + 1, F.lit(4 * values))


def common_prefix(key: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many leading values two keys of a row share."""
    return np.logical_and.accumulate(key == other, axis=1).sum(axis=1)


def adjacent(members: DataFrame) -> DataFrame:
    """(a, b, depth): sets next to each other in an order that share a region, and the longest of their common prefixes.

    members: tree, key, node. Ranges of the sorted orders are compared where they
    lie; what passes between them is a row for either end of a range.
    """
    kind = members.schema["node"]
    names = ["a", "b", "depth", "part", "tree", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None

        def rows(a, b, depth, part=None, tree=None, key=None) -> pa.RecordBatch:
            n, ints, node = len(depth), pa.int32(), members_type
            filled = [pa.array(a, node), pa.array(b, node) if b is not None else pa.nulls(n, node), pa.array(depth, ints)]
            filled += [pa.array([x] * n, t) for x, t in ((part, ints), (tree, ints), (key, pa.binary()))]
            return pa.RecordBatch.from_arrays(filled, names)

        for batch in batches:
            if not batch.num_rows:
                continue
            members_type = batch.column(2).type
            tree, keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            if last is None:
                yield rows(nodes[:1], None, [0], part, int(tree[0]), keys[0])
            else:
                tree, keys, nodes = np.append(last[0], tree), [last[1], *keys], [last[2], *nodes]
            last = (tree[-1], keys[-1], nodes[-1])
            key = np.frombuffer(b"".join(keys), ">u4").reshape(-1, DEPTH)
            depth = common_prefix(key[1:], key[:-1]) * (tree[1:] == tree[:-1])
            at = np.flatnonzero(depth >= NEAR)
            yield rows([nodes[i] for i in at], [nodes[i + 1] for i in at], depth[at])
        if last is not None:
            yield rows([last[2]], None, [1], part, int(last[0]), last[1])

    order = ["tree", "key", "node"]
    shape = [StructField(x, kind.dataType) for x in "ab"] + [StructField(x, IntegerType()) for x in ("depth", "part", "tree")] + [StructField("key", BinaryType())]
    found = written(members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, StructType(shape)))
    ends = found.where("part IS NOT NULL").orderBy("part", "depth").collect()  # two rows for each range
    met = []
    for x, y in zip(ends[1::2], ends[2::2]):
        depth = int(common_prefix(*(np.frombuffer(r["key"], ">u4").reshape(1, DEPTH) for r in (x, y)))[0])
        if x["tree"] == y["tree"] and depth >= NEAR:
            met.append((x["a"], y["a"], depth))
    pairs = found.where("part IS NULL").select("a", "b", "depth").union(members.sparkSession.createDataFrame(met, StructType(shape[:3])))
    return pairs.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("depth").alias("depth"))


def nearest(pairs: DataFrame) -> DataFrame:
    """Of each set's pairs the deepest, ties to the smaller partner."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))
    each = pairs.select("depth", F.explode(ends).alias("e")).select("depth", "e.*")
    best = each.groupBy("node").agg(F.min(F.struct((-F.col("depth")).alias("up"), "to")).alias("best"))
    return best.select(F.least("node", "best.to").alias("a"), F.greatest("node", "best.to").alias("b")).distinct()


def prefixes(pool: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, n, left, shingle): of each set's prefix the shingles that several components have, and how many of all its
    such shingles come no earlier in the order; pool: node, component."""
    held = sets.join(pool, "node").select("node", "digest", "component", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    span = held.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("often"))
    both = held.join(span.where("low <> high").select("shingle", "often"), "shingle")
    listed = both.groupBy("node", "digest", "n").agg(F.sort_array(F.collect_set(F.struct("often", "shingle"))).alias("shared"))
    reach = F.expr(f"n - ({PERCENT} * n + 99) DIV 100 + 1") - (F.col("n") - F.size("shared"))  # the rest of the prefix is shingles of one component
    kept = listed.where(reach > 0).select("node", "n", F.size("shared").alias("most"), F.posexplode(F.slice("shared", F.lit(1), reach.cast("int"))).alias("at", "s"))
    return written(kept.select("node", "n", (F.col("most") - F.col("at")).alias("left"), "s.shingle"))


def _sizes_fit(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def merged(first: DataFrame, known: DataFrame, sets: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Links found by comparing each set with HOSTS sets drawn at each of its shingles, and the components then.

    Near copies by the thousands become one component in a few of these rounds,
    each linear in the shingles, so that they needn't be paired with each other.
    Rounds end when few links are found; what is left open is for open_pairs().
    """
    links, nodes = [], known.count()
    for turn in range(MERGES):
        placed = first.join(known, "node")
        drawn = [F.min(F.struct(F.xxhash64("node", F.lit(HOSTS * turn + k)).alias("at"), F.col("node").alias("host"), F.col("n").alias("n_host"), F.col("component").alias("home"))) for k in range(HOSTS)]
        hosts = placed.groupBy("shingle").agg(F.array(*drawn).alias("h"), F.min("component").alias("low"), F.max("component").alias("high"))
        hosts = written(hosts.where("low <> high").select("shingle", F.explode(F.array_distinct("h")).alias("h")).select("shingle", "h.host", "h.n_host", "h.home"))
        guests = placed.join(hosts, "shingle").where((F.col("component") != F.col("home")) & _sizes_fit("n", "n_host"))
        pairs = written(guests.select(F.least("node", "host").alias("a"), F.greatest("node", "host").alias("b")).distinct())
        many = pairs.count()
        found = written(linked(compared(pairs, sets)).select("a", "b"), 4 * many)
        links.append(found)
        name = lambda x: known.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
        labels = smallest_labels(found.join(name("a"), "a").join(name("b"), "b").select("c_a", "c_b"), "c_a", "c_b")
        labels = labels.select(F.col("node").alias("component"), F.col("component").alias("label"))
        before, known = known, written(known.join(labels, "component", "left").select("node", F.coalesce("label", "component").alias("component")), nodes)
        drop_table(before, hosts, pairs)
        if FEW * found.count() < many:
            break
    return links, known


def sizes_met(entries: DataFrame) -> DataFrame:
    """entries (n, left) once for each class of sizes that a partner may have.

    At the first shingle that two sets have in common, all that they share is left
    in both lists, so a partner's size is between three quarters of a set's own
    and what the rest of the list suffices for. Classes are SIZE_STEP wide.
    """
    low = F.expr(f"({PERCENT} * n + 99) DIV 100")
    high = F.least(F.expr(f"100 * n DIV {PERCENT}"), F.expr(f"(100 + {PERCENT}) * left DIV {PERCENT} - n"))
    return entries.where(low <= high).withColumn("class", F.explode(F.sequence(size_class(low), size_class(high))))


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(1 + SIZE_STEP)).cast("int")


def open_pairs(first: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle of their prefixes and may share enough from there on.

    The join is on the shingle and the class of sizes, so what shares a frequent
    passage but too little else doesn't meet at all.
    """
    placed = first.join(known, "node")
    by = placed.groupBy("shingle", "component").count().groupBy("shingle").agg(F.count("*").alias("components"), F.max_by("component", F.struct("count", "component")).alias("home"))
    placed = written(placed.join(by.where("components > 1").select("shingle", "home"), "shingle"))
    guests = sizes_met(placed.where("component <> home")).withColumnsRenamed({c: f"{c}_a" for c in ("node", "component", "n", "left")}).drop("home")
    hosts = placed.withColumn("class", size_class(F.col("n"))).withColumnsRenamed({c: f"{c}_b" for c in ("node", "component", "n", "left")}).drop("home")
    enough = (100 + PERCENT) * F.least("left_a", "left_b") >= PERCENT * (F.col("n_a") + F.col("n_b"))
    met = guests.join(hosts, ["shingle", "class"]).where(F.col("component_a") != F.col("component_b")).where(_sizes_fit("n_a", "n_b") & enough)
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind, longs = docs.schema["doc_id"].dataType, ArrayType(LongType())
    shape = [StructField("doc_id", kind), StructField("n_shingles", LongType()), StructField("digest", BinaryType()), StructField("minima", BinaryType())]
    signed = written(docs.mapInPandas(_signed, StructType(shape)))
    named = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    single = named.groupBy("digest").agg(F.min(F.struct("doc_id", "minima")).alias("least")).select("digest", F.col("least.doc_id").alias("node"), "least.minima")
    single = written(single)
    copies = named.select("doc_id", "digest").join(single.select("digest", "node"), "digest").where("node < doc_id").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))

    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    keys = single.select("digest", "node", trees, "minima").select("digest", "node", "tree", F.xxhash64("tree", order_key(F.col("tree"), NEAR)).alias("near"))
    regions = keys.groupBy("near").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    members = written(keys.join(regions.select("near"), "near"))
    compare = written(members.select("node").distinct())
    sets = docs.join(compare.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    sets = sets.mapInPandas(_full_sets, StructType([StructField("node", kind), StructField("digest", BinaryType()), StructField("shingles", longs)]))
    sets = written(sets.where(F.size("shingles") > 0))

    placed = members.drop("node").join(single, "digest")
    beside = written(adjacent(placed.select("tree", order_key(F.col("tree"), DEPTH).alias("key"), "node")))
    many, near = compare.count(), beside.count()
    tests: list[DataFrame] = []
    waiting = beside
    for _ in range(ROUNDS):
        tests.append(written(compared(nearest(waiting), sets), many))
        found = linked(tests[-1]).select(F.explode(F.array("a", "b")).alias("node")).distinct()
        rest = waiting.join(tests[-1].select("a", "b"), ["a", "b"], "left_anti")
        rest = written(rest.join(found.withColumnRenamed("node", "a"), "a", "left_anti").join(found.withColumnRenamed("node", "b"), "b", "left_anti"), near)
        drop_table(waiting)
        waiting = rest
    tested = reduce(DataFrame.union, tests)
    links = written(linked(tested).select("a", "b"), ROUNDS * many)
    labels = smallest_labels(links)
    known = written(compare.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component")), many)
    placed = members.select("near", "node").join(known, "node")
    mixed = placed.groupBy("near").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    pool = written(placed.join(mixed.select("near"), "near").select("node", "component").distinct(), many)
    drop_table(waiting, labels, known, members, compare)
    first = prefixes(pool, sets)
    more, pool = merged(first, pool, sets)
    drop_table(first)
    first = prefixes(pool, sets)
    rest = written(open_pairs(first, pool).join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    last = written(linked(compared(rest, sets)).select("a", "b"))
    component = smallest_labels(reduce(DataFrame.union, [links, *more, last, copies])).withColumnRenamed("node", "doc_id")
    drop_table(first, pool, rest, last, sets, single, links, *more, *tests)
    out = signed.select("doc_id", "n_shingles").join(component, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of links of similarity 0.75 and more on five-word shingles."""
    return near_duplicates(read(spark, sf_dir, "documents"))
