"""What the corpus operators share: reading, shared scratch tables, components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in spark.checkpoint.dir. Where that is unset, a session
    on one machine, as in tests, makes and sets a folder of its own; on a cluster
    no folder could be guessed, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Rows of a small table to one file, and its least number of files.
FILE_ROWS, LEAST_FILES = 250_000, 8


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df written once to the shared folder and read back.

    Cuts the lineage: a lost executor makes Spark read the table again, not
    compute it again, and later uses read only the columns they need. rows: how
    many there are at most, where that is known; few rows become few files,
    whatever the number of partitions, as each file costs more than its rows.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"tidemark-{uuid.uuid4().hex}")
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


#: Where the tables of written() are, by the frame that reads them.
_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def drop_table(*tables: DataFrame) -> None:
    """Delete tables made by written(); nothing may read them afterwards."""
    for df in tables:
        held, name = _PATHS.pop(id(df), (None, ""))
        if held is not None and held() is df:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Hand what this Python worker has freed back to the system, at the end of a task: workers outlive their tasks,
    and an executor's memory is shared by the next stage's workers and the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def smallest_labels(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components: (node, component) for every node of an edge list.

    A component's name is its smallest node. Each round maps every node to the
    smallest of its neighbourhood, jumps along that map twice, contracts the
    edges by it and composes it with what was found before; a star ends after
    one round and a chain loses three quarters of its nodes a round. The groups
    only take minima, so a hub's edges are summed up where they lie, and joins
    on a hub's key are split by adaptive execution.
    """
    edges = written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    left = edges.count()
    nodes = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("component")), 2 * left)
    named = nodes.count()
    for _ in range(rounds):
        if not left:
            drop_table(edges)
            return nodes
        both = edges.select(F.col("b").alias("node"), F.col("a").alias("to")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("to")))
        step = written(both.groupBy("node").agg(F.min("to").alias("to")), 2 * left)
        for _ in range(2):
            over = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
            further = written(step.join(over, "to", "left").select("node", F.coalesce("next", "to").alias("to")), 2 * left)
            drop_table(step)
            step = further
        found = nodes.join(step.select(F.col("node").alias("component"), "to"), "component", "left")
        found = written(found.select("node", F.coalesce("to", "component").alias("component")), named)
        ends = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b")
        rest = written(ends.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a < b").distinct(), left)
        drop_table(nodes, edges, step)
        nodes, edges, left = found, rest, rest.count()
    raise RuntimeError(f"components not found in {rounds} rounds")


def letters(text: Column) -> Column:
    """Whether a text holds a letter of any script."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
