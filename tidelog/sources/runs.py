"""Sorted runs as files of their own: written outside a store, checked, and taken in by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.visible import ordered
from .store import Store

RUN = "key string, kind int, value string"


def write_run(rows: DataFrame, path: str) -> dict:
    """rows(key, kind 1 put / 0 delete, value) -> Parquet files, each sorted and all in key order, and their entries, smallest and largest key.

    A key that is null or occurs twice is refused before anything is written, as is a kind that is neither.
    """
    bad = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("kind").isin(0, 1)).alias("known"))
    if bad.where("key is null or n > 1 or not coalesce(known, false)").limit(1).count():
        raise ValueError("a run holds each key once, as a put or a delete")
    rows.select(F.col("key").cast("string"), F.col("kind").cast("int"), F.col("value").cast("string")).repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)
    return run_info(rows.sparkSession, path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).parquet(path)


def run_info(spark: SparkSession, path: str) -> dict:
    """Entries, smallest and largest key and bytes of a run."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    one = read_run(spark, path).agg(F.count(F.lit(1)).alias("entries"), F.min("key").alias("smallest"), F.max("key").alias("largest")).first()
    return {**one.asDict(), "bytes": size}


def run_faults(spark: SparkSession, path: str) -> DataFrame:
    """One row (repeated, overlapping): keys that occur more than once, and pairs of files next to each other whose keys overlap."""
    x = read_run(spark, path).select("key", F.col("_metadata.file_path").alias("file"))
    repeated = x.groupBy("key").count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated"))
    ends = x.groupBy("file").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    ends = ordered(ends, ["lo", "file"])
    pairs = ends.alias("a").join(ends.alias("b"), F.col("b.n") == F.col("a.n") + 1).where(F.col("a.hi") >= F.col("b.lo")).agg(F.count(F.lit(1)).alias("overlapping"))
    return repeated.crossJoin(pairs)  # one row each


def ingest_run(store: Store, path: str, family: str = "default") -> int:
    """A run as one commit with fresh sequences in key order, its deletes included."""
    rows = ordered(read_run(store.spark, path), ["key"])
    op = F.when(F.col("kind") == 1, "put").otherwise("delete")
    return store.write(rows.select(F.col("n").alias("pos"), F.lit(family).alias("cf"), op.alias("op"), "key", "value"))
