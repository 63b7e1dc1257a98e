"""Writers: idempotent appends, exports, static pages and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemark.operators.store import first_writes


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.parquet(path) if there else None


def append_first(rows: DataFrame, path: str, key: list[str], order: list[Column], partition: list[str] | None = None) -> None:
    """Append the keys that the table doesn't have; doing it again adds nothing."""
    new = first_writes(rows, _stored(rows.sparkSession, path), key, order)
    new.write.mode("append").partitionBy(*(partition or [])).parquet(path)


def export(rows: DataFrame, path: str, kind: str, order: list[Column]) -> None:
    """Rows as csv or jsonl in a total order; range partitioning keeps it across files."""
    if kind not in ("csv", "jsonl"):
        raise ValueError(f"unknown format: {kind}")
    ordered = rows.orderBy(*order)
    if kind == "csv":
        ordered.write.csv(path, header=True)
    else:
        ordered.write.json(path, ignoreNullFields=False)


def static_pages(rows: DataFrame, path: str, order: list[Column], size: int) -> None:
    """Pages of so many rows as JSON, a folder each.

    A page is a range of ranks. Ranks come from the number of rows in each range
    partition and the place within it, not from one window over all rows.
    """
    pages(rows, order, size).write.partitionBy("page").json(path)


def pages(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """rows with rank from 0 and page."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    counts = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("n"), F.min("__id").alias("__low"))
    before = F.sum("n").over(W.partitionBy().orderBy("__part")) - F.col("n")  # a row for each partition
    starts = counts.select("__part", "__low", before.alias("__before"))
    ranked = dealt.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("rank", F.col("__before") + F.col("__id") - F.col("__low"))
    return ranked.withColumn("page", F.floor(F.col("rank") / size)).drop("__id", "__part", "__low", "__before")


def archive(rows: DataFrame, path: str) -> DataFrame:
    """Write rows as gzipped JSON and return a manifest: each file's rows, bytes and SHA-256."""
    rows.write.option("compression", "gzip").json(path)
    spark = rows.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json.gz").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    lines = spark.read.text(path).groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("rows"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("file", name).drop("path").join(lines.withColumn("file", name).drop("path"), "file", "left").fillna(0, ["rows"])
